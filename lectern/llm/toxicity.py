"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed and of a learned lexicon, nearness of second-person words to insults,
concentration, capitals, punctuation and obfuscation. The learned lexicon and the trees come from separate parts of a
bounded sample of labelled rows; a third part calibrates. Scoring is one pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import durable, keep_only, small_batches, tidied, words

#: Bound of the labelled sample that is fitted on the driver (its features, not its texts).
TRAIN_ROWS = 20_000
#: Learned words and word beginnings: at most so many, each in at least this share and number of the toxic texts of its
#: part, and so much likelier there than in others.
LEARNED, LEARNED_SHARE, LEARNED_LEAST, LEARNED_ODDS = 400, 0.02, 4, 10.0
#: Lengths of the beginnings, which catch inflected forms of one insult.
STEMS = range(5, 10)
FOLDS = 5

#: Insults and second-person words of the four languages of the corpus. Words that one of these languages uses
#: in plain sentences (die, hate, kill, shut, trash, ihr, su ...) are left to the learned lexicon, which has seen the corpus.
INSULTS = frozenset(
    """idiot idiots stupid moron morons scum loser losers pathetic worthless disgusting clown dumb imbecile
    filthy vermin bastard bitch asshole jerk freak
    dummkopf trottel abschaum widerlich wertlos arschloch dreckskerl
    imbécile connard salaud abruti débile minable raclure
    idiota estúpido imbécil asqueroso escoria patético""".split()
)
SECOND_PERSON = frozenset("you your yours you're yourself du dich dir dein deine euch tu toi ta tes vous votre tú ti usted ustedes".split())
NEAR = 5
STRETCH = 50
_APART = {i: " " for i in range(128) if not chr(i).isalnum() and chr(i) not in "'"} | {ord(c): " " for c in "¡¿«»“”„…–—"}
_LEET = str.maketrans("013457@$!", "oieastasi")
_OBFUSCATED = regex.compile(r"\b[\p{L}]+[0-9@$!*#_.\-]+[\p{L}]+[\p{L}0-9@$!*]*")
FEATURES = ("fixed_rate", "learned_rate", "fixed_count", "learned_count", "near_second_person", "second_person_rate", "concentration", "capital_rate", "shouted_rate", "exclaim_rate", "punctuation_rate", "obfuscated_rate", "unmasked_count", "log_words")


@dataclass(frozen=True)
class Lexicon:
    """Learned words, stems, and the shortest beginnings of stems, which spare most words a closer look."""

    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()

    @cached_property
    def starts(self) -> frozenset[str]:
        return frozenset(s[: STEMS[0]] for s in self.stems)

    def of(self, kinds: set[str]) -> set[str]:
        starts, stems, n = self.starts, self.stems, STEMS[0]
        return (kinds & self.words) | {w for w in kinds if w[:n] in starts and any(w[:k] in stems for k in STEMS)}


def text_features(text: str | None, learned: Lexicon) -> tuple[float, ...]:
    text = text or ""
    lower = text.lower()
    found = lower.translate(_APART).split()
    n = max(1, len(found))
    kinds = set(found)
    fixed_kinds, learned_kinds = kinds & INSULTS, learned.of(kinds)
    fixed = near = learned_n = most = 0
    if fixed_kinds or learned_kinds:
        either = fixed_kinds | learned_kinds
        spots = [i for i, w in enumerate(found) if w in either]
        fixed = sum(found[i] in fixed_kinds for i in spots)
        learned_n = sum(found[i] in learned_kinds for i in spots)
        near = sum(any(w in SECOND_PERSON for w in found[max(0, i - NEAR) : i + NEAR + 1]) for i in spots) / len(spots)
        lo = 0
        for hi, i in enumerate(spots):
            while i - spots[lo] >= STRETCH:
                lo += 1
            most = max(most, hi - lo + 1)
    second = sum(map(found.count, kinds & SECOND_PERSON))
    masked = _OBFUSCATED.findall(lower)
    unmasked = sum(m.translate(_LEET).translate(_APART).replace(" ", "") in INSULTS for m in masked)
    chars = max(1, len(text))
    capitals = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.translate(_NO_CAPITALS))
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if capitals else 0
    marks = len(text) - len(text.translate(_NO_MARKS))
    return (fixed / n, learned_n / n, min(fixed, 50), min(learned_n, 50), near, second / n, most, capitals / chars, shouted / n, text.count("!") / n, marks / chars, len(masked) / n, min(unmasked, 20), float(np.log1p(len(found))))


_NO_CAPITALS = dict.fromkeys(range(65, 91))
_NO_MARKS = dict.fromkeys(map(ord, "!?.,;:#*$%&|<>\"'()[]{}-_/\\@^~`+="))


def _featured(docs: DataFrame, learned: Lexicon, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns and one double for each feature."""
    source = small_batches(docs).select(*keep, "text")
    schema = ", ".join([f"`{c}` {t}" for c, t in source.dtypes[:-1]] + [f"{f} double" for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t.as_py(), learned) for t in b.column(b.num_columns - 1)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, x.T.copy())], names=[*keep, *FEATURES])

    return source.mapInArrow(tidied(run), schema)


def fold() -> Column:
    """crc32 of doc_id as text, modulo 5; a null doc_id counts as empty text. Fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[boost.Boosted | None, Lexicon]:
    """Model and learned lexicon from at most ``train_rows`` labelled rows outside the held-out fold."""
    fair = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = fair.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).withColumn("part", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(5)))
    texts = durable(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    found = texts.where("part < 2").select("toxic", F.array_distinct(words(F.regexp_replace(F.lower("text"), r"[\p{Punct}]+", " "))).alias("w"))
    stems = F.flatten(F.transform("w", lambda w: F.filter(F.transform(F.array(*map(F.lit, STEMS)), lambda k: F.when(F.length(w) >= k, F.concat(F.substring(w, F.lit(1), k), F.lit("*")))), lambda x: x.isNotNull())))
    first = found.select("toxic", F.explode(F.concat("w", F.array_distinct(stems))).alias("w"))
    n = texts.where("part < 2").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).head()
    toxic, clean = float(n["t"] or 0), float((n["n"] or 0) - (n["t"] or 0))
    odds = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    counted = first.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where((F.col("t") >= max(LEARNED_LEAST, LEARNED_SHARE * toxic)) & (odds >= LEARNED_ODDS))
    got = [r["w"] for r in counted.orderBy(odds.desc(), "w").limit(10 * LEARNED).collect()]
    stems = frozenset(w[:-1] for w in got if w[-1] == "*")
    # what a shorter stem covers says nothing more
    told = [w for w in got if not any(w.rstrip("*")[:k] in stems for k in STEMS if k < len(w.rstrip("*")) + (w[-1] != "*"))][:LEARNED]
    learned = Lexicon(frozenset(w for w in told if w[-1] != "*"), frozenset(w[:-1] for w in told if w[-1] == "*"))
    rows = _featured(texts.where("part >= 2"), learned, ("toxic", "part", "doc_id")).orderBy("doc_id").collect()
    y, part = np.array([r["toxic"] for r in rows], float), np.array([r["part"] for r in rows])
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    if len(set(y[part < 4])) < 2 or len(set(y[part == 4])) < 2:
        return None, learned
    model = boost.fit(x[part < 4], y[part < 4])
    model.calibrate(x[part == 4], y[part == 4])
    return model, learned


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text); ``labels`` has doc_id and toxic.

    Null and empty texts are scored as texts without words. Repeated rows are scored each; extra columns are ignored;
    an empty table gives an empty result. Null labels teach nothing; of repeated labels the largest counts. Without
    labels of both kinds the share of fixed insults decides: 0.5 at one in a hundred words.
    """
    model, learned = learn(docs, labels, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for b in batches:
            x = np.array([text_features(t.as_py(), learned) for t in b.column(1)], np.float64).reshape(-1, len(FEATURES))
            p = model.probability(x) if model else x[:, 0] / (x[:, 0] + 0.01)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(p, 0.0, 1.0), pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    scored = small_batches(docs).select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
