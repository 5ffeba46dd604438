"""Adaptive limits and verdicts against exact quantiles."""

import collections
import math
import random

from pyspark.sql import functions as F

from lectern.llm import quality


def by_hand(rows):
    """kept of every (doc_id, lang, source, text) by the rule in words: exact quantiles, shrunk, fenced, with chance allowed."""
    measured = {}
    for d, lang, source, text in rows:
        n, chars, symbols, dups, repeats, lines, shouting, stutter = quality._counts(text)
        over = lambda a, b: a / b if b else 0.0
        one = lambda x: max(x, 1)
        rates = {"symbol_rate": (over(symbols, chars), one(chars)), "dup_line_rate": (over(dups, lines), one(lines)), "repeat_rate": (over(repeats, n), one(n)), "shout_rate": (over(shouting, chars), one(chars)), "stutter_rate": (over(stutter, n), one(n)), "word_length": (over(chars, n), one(n))}
        measured[d] = lang, source, n, n < 20 or 100 * repeats > 30 * n, rates
    levels = collections.defaultdict(list)
    for lang, source, n, _, rates in measured.values():
        if n:
            for key in ((lang, source), (lang,), ()):
                levels[key].append(rates)

    def quantiles(key, k, tail):
        v = sorted(r[k][0] for r in levels[key])
        return [v[max(0, math.ceil(round(q * len(v), 9)) - 1)] for q in (tail, 0.5, 1 - tail)]

    kept = {}
    for d, (lang, source, n, failed, rates) in measured.items():
        odd = False
        if n:
            for k, r in quality.RATES.items():
                of = [quantiles(key, k, r["tail"]) for key in ((lang, source), (lang,), ())]
                size_g, size_l = len(levels[lang, source]), len(levels[lang,])
                q = []
                for g, mid, every in zip(*of, strict=True):
                    above = (size_l * mid + 200 * every) / (size_l + 200)
                    q.append((size_g * g + 200 * above) / (size_g + 200))
                rate, size = rates[k]
                high = q[2] + r["fence"] * (q[2] - q[1])
                if k == "word_length":
                    low = q[0] - r["fence"] * (q[1] - q[0])
                    odd |= rate > high + 3 * high / (2 * math.sqrt(size)) or rate < low - 3 * max(low, 1.0) / (2 * math.sqrt(size))
                else:
                    odd |= rate > high + 3 * math.sqrt(high / size) + 8 / size
        kept[d] = not failed and not odd
    return kept


def test_limits_adapt(spark, sf):
    rng = random.Random(6)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "text").collect()]
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(30, 200)))
    priced = lambda: " ".join(f"{word()} $$$" for _ in range(rng.randint(30, 90)))
    shop = [(10_000 + i, "en", "shop", priced()) for i in range(200)]
    blog = [(20_000 + i, "en", "blog", prose() if i % 20 else priced()) for i in range(1500)]
    tiny = [(30_000 + i, "xx", None, prose()) for i in range(5)] + [(30_100, "xx", None, priced()), (30_101, None, None, None), (30_102, None, "a", " ")]
    rows = docs + shop + blog + tiny
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumn("kept", F.lit("clash"))
    got = {r["doc_id"]: r["kept"] for r in quality.quality_report(df).collect()}
    assert got == by_hand(rows)
    # the same pages are the style of one source and junk in another
    assert all(got[10_000 + i] for i in range(200)) and not any(got[20_000 + i] for i in range(0, 1500, 20))
    assert sum(got[20_000 + i] for i in range(1500) if i % 20) > 1420


def test_labelled_documents(spark):
    """Clean documents stay unless the base rule rejects them, and junk goes."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    got = quality.quality_report(d).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in got}
    assert share[1] >= 0.99 and share[0] <= 0.15, share
