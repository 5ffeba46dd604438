"""Removal of passages that repeat across documents, word window by word window, exactly.

The method named for this operator, suffix automata of reference shards that are broadcast, needs the automata of all
documents here, since all of them are the reference: their size has no bound and every document would stream through
every shard. Equal windows are found by content instead:

1. Documents with equal word sequences are one class; all but the smallest doc_id are repeats as a whole.
2. Each window of ``length`` words names the smallest hash among its ``GRAM``-word grams, its anchor. Equal windows have
   equal anchors, and neighbouring windows mostly share theirs, so a document has about one anchor in twenty words.
3. Anchors that only one document has rule out all windows that name them. Only windows of shared anchors go on.
4. Those windows are grouped by 128-bit hashes of their words; each group keeps its smallest doc_id, by partial
   aggregates, and every window of a larger doc_id is a repeat. A passage of a third of all documents is one row a task
   there; its places are dealt to many tasks before they meet that doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import caches, durable, keep_only, small_batches, tidied

LENGTH = 50
GRAM = 16
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
BROADCAST_ROWS = 1_000_000
REMEMBER = 200_000


#: Windows of more places than this are hot: their rows are dealt to so many parts before they meet their smallest doc_id.
HOT, SALTS = 2000, 64


class _WordHashes(dict):
    def __init__(self, seed: int) -> None:
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h


#: Two independent hashes of a word: anchors need one, windows both.
_words, _others = _WordHashes(0), _WordHashes(1)


def _forget() -> None:
    _words.clear()
    _others.clear()


caches["substring"] = _forget


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes split on the six ASCII white-space characters


def hashes(found: list[bytes], known: _WordHashes = _words) -> np.ndarray:
    if len(known) > REMEMBER:
        known.clear()
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def grams(h: np.ndarray, k: int, by: np.uint64) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` words, by doubling: runs of 2, 4, 8 ... words and their joins."""
    runs, size = h * by + np.uint64(1), 1
    done: np.ndarray | None = None
    have = 0
    while True:
        if k & size:
            if done is None:
                done, have = runs, size
            else:
                n = len(h) - have - size + 1
                done = (done[:n] ^ (done[:n] >> np.uint64(29))) * by + runs[have : have + n]
                have += size
        if have == k:
            done = (done ^ (done >> np.uint64(31))) * MIX2
            return done ^ (done >> np.uint64(29))
        n = len(h) - 2 * size + 1
        runs = (runs[:n] ^ (runs[:n] >> np.uint64(27))) * by + runs[size : size + n]
        size *= 2


def anchors(h: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The anchor of each window: the least gram hash within it."""
    low = grams(h, gram, MIX)
    span, size = length - gram + 1, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = span - size
    return np.minimum(low[: len(low) - rest], low[rest:])


def _sketch(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, text_key, n, q1, q2 (hash of the word sequence), anchors of each row."""
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("substring")
        for b in batches:
            n, q1, q2, low = [], [], [], []
            for t in b.column(2):
                found = split_words(t.as_py())
                n.append(len(found))
                digest = hashlib.blake2b(b" ".join(found), digest_size=16).digest()
                q1.append(int.from_bytes(digest[:8], "big", signed=True))
                q2.append(int.from_bytes(digest[8:], "big", signed=True))
                low.append(np.unique(anchors(hashes(found), length, gram)).view(np.int64) if len(found) >= length else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(q1, pa.int64()), pa.array(q2, pa.int64()), pa.array(low, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n", "q1", "q2", "anchors"])

    return small_batches(source).mapInArrow(tidied(run), "doc_id long, text_key long, n long, q1 long, q2 long, anchors array<long>")


def _windows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, text_key, at, w1, w2 of the windows that name a shared anchor (column shared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("substring")
        for b in batches:
            for i in range(b.num_rows):
                found = split_words(b.column(2)[i].as_py())
                h = hashes(found)
                own = np.array(b.column(3)[i].as_py(), np.int64).view(np.uint64)
                at = np.flatnonzero(np.isin(anchors(h, length, gram), own))
                w1, w2 = grams(h, length, MIX)[at].view(np.int64), grams(hashes(found, _others), length, MIX)[at].view(np.int64)
                size = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, b.column(0)[i].as_py())), pa.array(np.full(size, b.column(1)[i].as_py())), pa.array(at.astype(np.int32)), pa.array(w1), pa.array(w2)], names=["doc_id", "text_key", "at", "w1", "w2"])

    return small_batches(docs).select("doc_id", "text_key", "text", "shared").mapInArrow(tidied(run), "doc_id long, text_key long, at int, w1 long, w2 long")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, text_key, whole, starts: documents with windows that a smaller doc_id has too, and where they start.

    ``whole`` marks documents whose word sequence a smaller doc_id has as a whole; their starts are null.
    """
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    sketch = durable(_sketch(docs, length, gram).where(F.col("doc_id").isNotNull() & (F.col("n") >= length)))
    classes = sketch.groupBy("q1", "q2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1")
    copies = sketch.select("doc_id", "text_key", "q1", "q2").join(classes, ["q1", "q2"])
    whole = durable(copies.where("doc_id > rep").select("doc_id", "text_key").distinct())
    rest = sketch.join(few(whole), ["doc_id", "text_key"], "left_anti")
    named = rest.select("doc_id", "text_key", F.explode("anchors").alias("anchor"))
    shared = durable(named.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"))
    own = durable(named.join(few(shared), "anchor", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("shared")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    hopeful = keyed.join(few(own.select("doc_id", "text_key")), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]).join(own, ["doc_id", "text_key"])
    windows = durable(_windows(hopeful, length, gram))
    first = durable(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("m")).where("low < high").select("w1", "w2", "low", (F.col("m") > hot).alias("hot")))
    many = first.where("hot").select("w1", "w2", "hot")
    # at most one hot window in ``hot`` rows; beyond the bound, adaptive execution splits what is skewed
    salts = SALTS if 0 < many.count() <= BROADCAST_ROWS else 1
    if salts > 1:
        windows = windows.join(F.broadcast(many), ["w1", "w2"], "left")
        windows = windows.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "at"), F.lit(salts)).cast("int")).otherwise(0)).drop("hot")
    else:
        windows = windows.withColumn("part", F.lit(0))
    dealt = first.withColumn("part", F.explode(F.when(F.col("hot") & F.lit(salts > 1), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    again = windows.join(dealt, ["w1", "w2", "part"]).where("doc_id > low").groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("starts"))
    return again.select("doc_id", "text_key", F.lit(False).alias("whole"), "starts").unionByName(whole.select("doc_id", "text_key", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by one space), spans (start, end in words) of every row.

    A word goes when a window of ``length`` words covers it that also starts in a document of smaller doc_id; windows
    are judged on the input. Null, empty and shorter texts lose nothing. Rows of one doc_id are no reference for each
    other; rows without doc_id are neither cut nor a reference. Extra columns are ignored.
    """
    marks = durable(repeats(docs, length, gram, hot))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    ids = marks.select("doc_id", "text_key")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    # only documents with repeats meet their marks in a shuffle
    cut = keyed.join(ids, ["doc_id", "text_key"], "left_semi").join(marks, ["doc_id", "text_key"]).select("doc_id", "text", "whole", "starts")
    same = keyed.join(ids, ["doc_id", "text_key"], "left_anti").select("doc_id", "text", F.lit(False).alias("whole"), F.lit(None).cast("array<int>").alias("starts"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept, spans = [], [], [], []
            for t, whole, starts in zip(b.column(1), b.column(2), b.column(3), strict=True):
                found = split_words(t.as_py())
                n.append(len(found))
                starts = starts.as_py()
                if whole.as_py():
                    found, gone, at = [], len(found), [(0, len(found))]
                elif starts:
                    step = np.zeros(len(found) + 1, np.int64)
                    np.add.at(step, starts, 1)
                    np.add.at(step, np.array(starts) + length, -1)
                    stay = np.cumsum(step)[:-1] == 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]]).astype(np.int8)))
                    at = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
                    gone = int((~stay).sum())
                    found = [found[i] for i in np.flatnonzero(stay)]
                else:
                    gone, at = 0, []
                removed.append(gone)
                kept.append(b" ".join(found).decode("utf-8", "surrogatepass"))
                spans.append([{"start": s, "end": e} for s, e in at])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span)], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return cut.unionByName(same).mapInArrow(tidied(run), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>")
