"""Quality rules with thresholds that adapt to each language and source.

Per document a handful of counts is taken from the whole text. Mergeable quantile sketches of the derived rates, kept for
every (lang, source), every language and the whole table in one rollup, replace fixed cutoffs:

1. Of each rate the median and a tail quantile are read from the three sketches. A group's quantiles are shrunk to those of
   its language, and these to the whole's, by the numbers of documents: a small group with a few junk pages doesn't take
   them for its style, a large one sets its own.
2. A limit lies ``fence`` times the distance from median to tail beyond the tail.
3. A document is rejected when a rate passes its group's limit by more than chance allows in a text of its size, which
   spares short documents.

The sketches are partial aggregates, so a group with a third of all rows costs no more than any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import durable, keep_only, small_batches, trim

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

COUNTS = T.StructType([T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouting", "n_stutter")])

#: Of each rate: the share of documents beyond its tail quantile, and how far beyond the tail the limit lies, in distances
#: from median to tail. Passages and lines repeat in a few clean documents of any source, so their tails reach further out.
RATES = {
    "symbol_rate": {"tail": 0.10, "fence": 3.0},
    "dup_line_rate": {"tail": 0.01, "fence": 1.0},
    "repeat_rate": {"tail": 0.01, "fence": 1.0},
    "shout_rate": {"tail": 0.10, "fence": 3.0},
    "stutter_rate": {"tail": 0.10, "fence": 3.0},
    "word_length": {"tail": 0.10, "fence": 3.0},
}
#: The rate that has a lower limit too, at the same tail and fence.
TWO_SIDED = "word_length"
#: A group's own quantiles weigh as its documents do against so many of the level above.
SHRINK = 200
#: What chance allows beyond a limit: so many standard deviations of a count at the limit, and so many events.
DEVIATIONS, EVENTS = 3.0, 8.0
#: Rank error of the sketches is 1 / ACCURACY.
ACCURACY = 1000


def _counts(text: str | None) -> tuple[int, ...]:
    b = (text or "").encode("utf-8", "surrogatepass")
    found = b.split()  # bytes.split() splits on exactly the six ASCII white-space characters
    n = len(found)
    if not n:
        return 0, 0, 0, 0, 0, 0, 0, 0
    chars = len(b.translate(None, CONTINUATION + SPACES))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip()]
    repeated = 0
    h = np.fromiter(map(hash, found), np.int64, n).view(np.uint64)
    stutter = int((h[1:] == h[:-1]).sum())
    if n >= WINDOW:
        acc = np.zeros(n - WINDOW + 1, np.uint64)
        for j in range(WINDOW):
            acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : n - WINDOW + 1 + j]
        order = np.argsort(acc, kind="stable")
        s = acc[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(len(s), bool)
            twice[1:] |= same
            twice[:-1] |= same
            starts = order[twice]
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + WINDOW, -1)
            repeated = int((np.cumsum(step)[:n] > 0).sum())
    shouting = len(b) - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), shouting, stutter


@pandas_udf(COUNTS)
def quality_counts(text: pd.Series) -> pd.DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, A-Z and words equal to their forerunner, of each whole text."""
    keep_only()
    made = pd.DataFrame([_counts(t) for t in text], columns=COUNTS.names)
    trim()
    return made


# pure, but marked: the optimiser would push a filter on its result below a join and run it once more there
quality_counts = quality_counts.asNondeterministic()


def base_failed(m: Column | str = "__q") -> Column:
    c = lambda k: F.col(f"{m}.{k}")
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))


def _rates(m: str) -> dict[str, Column]:
    c = lambda k: F.col(f"{m}.{k}").cast("double")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return {
        "symbol_rate": per(c("n_symbols"), c("word_chars")),
        "dup_line_rate": per(c("n_dup_lines"), c("n_lines")),
        "repeat_rate": per(c("n_repeat_words"), c("n_words")),
        "shout_rate": per(c("n_shouting"), c("word_chars")),
        "stutter_rate": per(c("n_stutter"), c("n_words")),
        "word_length": per(c("word_chars"), c("n_words")),
    }


def _sizes(m: str) -> dict[str, Column]:
    """What each rate is a share of."""
    c = lambda k: F.greatest(F.col(f"{m}.{k}"), F.lit(1)).cast("double")
    return {"symbol_rate": c("word_chars"), "dup_line_rate": c("n_lines"), "repeat_rate": c("n_words"), "shout_rate": c("word_chars"), "stutter_rate": c("n_words"), "word_length": c("n_words")}


def thresholds(counted: DataFrame, m: str = "__q") -> DataFrame:
    """One row per (lang, source): the limits of every rate, from quantile sketches of three levels."""
    rates = counted.where(F.col(f"{m}.n_words") > 0).select("lang", "source", *[v.alias(f"__{k}") for k, v in _rates(m).items()])
    read = lambda k, r: F.percentile_approx(f"__{k}", [r["tail"], 0.5, 1 - r["tail"]], ACCURACY).alias(k)
    levels = rates.rollup("lang", "source").agg(F.grouping_id().alias("__level"), F.count("*").alias("__n"), *[read(k, r) for k, r in RATES.items()])
    levels = durable(levels)  # a row a group
    group = levels.where("__level = 0")
    above = lambda level, mark: levels.where(F.col("__level") == level).select(F.col("lang").alias(f"__{mark}_lang"), F.col("__n").alias(f"__{mark}_n"), *[F.col(k).alias(f"__{mark}_{k}") for k in RATES])
    # one row a language, one in all
    met = group.join(F.broadcast(above(1, "l")), F.col("lang").eqNullSafe(F.col("__l_lang"))).join(F.broadcast(above(3, "a").drop("__a_lang")))
    towards = lambda n, own, rest: (n * own + SHRINK * rest) / (n + SHRINK)
    limits = []
    for k, r in RATES.items():
        low, middle, high = (towards(F.col("__n"), F.col(k)[i], towards(F.col("__l_n"), F.col(f"__l_{k}")[i], F.col(f"__a_{k}")[i])) for i in range(3))
        limits.append((high + r["fence"] * (high - middle)).alias(f"__hi_{k}"))
        if k == TWO_SIDED:
            limits.append((low - r["fence"] * (middle - low)).alias(f"__lo_{k}"))
    # stored, so that the planner knows how few they are
    return durable(met.select(F.col("lang").alias("__t_lang"), F.col("source").alias("__t_source"), *limits))


def _odd(m: str) -> Column:
    """Whether a rate lies further beyond its limit than chance allows in a text of its size."""
    odd = F.lit(False)
    for k, v in _rates(m).items():
        high, size = F.col(f"__hi_{k}"), _sizes(m)[k]
        if k == TWO_SIDED:  # a mean: lengths of words spread about half as far as they reach
            low = F.col(f"__lo_{k}")
            odd = odd | (v > high + DEVIATIONS * high / (2 * F.sqrt(size))) | (v < low - DEVIATIONS * F.greatest(low, F.lit(1.0)) / (2 * F.sqrt(size)))
        else:
            odd = odd | (v > high + DEVIATIONS * F.sqrt(high / size) + EVENTS / size)
    return odd


def judge(counted: DataFrame, limits: DataFrame, m: str = "__q") -> DataFrame:
    """Add base_failed and kept (as __base_failed, __kept) to rows that carry counts ``m``, lang and source."""
    joined = counted.join(limits, counted["lang"].eqNullSafe(limits["__t_lang"]) & counted["source"].eqNullSafe(limits["__t_source"]), "left")
    return joined.withColumn("__base_failed", base_failed(m)).withColumn("__kept", ~F.col("__base_failed") & ~F.coalesce(_odd(m), F.lit(False)))


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts, base verdict and final verdict of every document (doc_id, lang, source, text).

    Null or blank text counts no words and fails the base rule. Null lang or source form groups of their own.
    Repeated rows are judged each. Extra columns are ignored. An empty table gives an empty result.
    """
    counted = durable(small_batches(docs).select("doc_id", "lang", "source", quality_counts("text").alias("__q")))
    return judge(counted, thresholds(counted)).select("doc_id", *[F.col(f"__q.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Counts are taken once and stored beside the texts; only the limits, one row per language and source, are joined.
    """
    counted = durable(small_batches(docs).withColumn("__q", quality_counts("text")))
    return judge(counted, thresholds(counted)).where("__kept").select(*[counted[c] for c in docs.columns])
