"""Scores of questions and pages by blocks: no row is ever a pair.

Pages become blocks, one row a block: a matrix of up to ``BLOCK`` vectors. Questions become tiles of up to ``TILE``. A block meets
each tile in one matrix product; a task keeps the best ``k`` of each question that it has seen, and only these states leave it. They
are merged by row numbers, which take as many rows a question as there are tasks, times k.

A task holds one Arrow batch of blocks and tiles, the product of ``STRIP`` questions and a block (8 MB) and the states of at most ``STATES`` tiles
(k x 16 bytes a question); older states leave early, which costs rows, not results. Blocks of long vectors have fewer rows (``BYTES``). Few
tiles are broadcast, many are crossed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small, small_batches

BLOCK, TILE, STATES = 4096, 1024, 64
#: Questions that a block is scored for at a time, and the bytes of vectors in a block.
STRIP, BYTES = 256, 2 << 20
#: So many tiles are broadcast at most: some 64 MB of 64-dimensional questions.
TILES = 128
#: Scores are compared to so many digits: the order of additions in a product shows in later ones.
DIGITS = 12

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _packed(rows: DataFrame, keys: tuple[str, ...], most: int, prefix: str) -> DataFrame:
    """One row a block: its keys and its vectors v, as bytes. Rows without a key, without a vector or with a null component take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = most if prefix == "q" else max(1, min(most, BYTES * batch.num_rows // max(1, 8 * len(pc.list_flatten(batch.column("v"))))))
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                flat, numbers = pc.list_flatten(part.column("v")).to_numpy(), np.stack([part.column(k).to_numpy() for k in keys], axis=1)
                if len(flat) % part.num_rows:
                    raise ValueError("vectors of a table must have one length")
                yield pa.RecordBatch.from_arrays([pa.array([numbers.tobytes()], pa.binary()), pa.array([flat.astype(np.float64).tobytes()], pa.binary())], names=["keys", "vectors"])

    given = rows.select(*[F.col(k).cast("long").alias(k) for k in keys], F.transform("v", lambda x: x.cast("double")).alias("v")).dropna(subset=list(keys))
    given = given.where(F.size("v") > 0).where(~F.exists("v", lambda x: x.isNull()))
    return small_batches(given).mapInArrow(run, "keys binary, vectors binary").select(F.col("keys").alias(f"{prefix}_keys"), F.col("vectors").alias(f"{prefix}_vectors"))


def _met(questions: DataFrame, pages: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """Every block of pages (``keys``, v) with every tile of questions (qid, v)."""
    n = questions.count()
    tiles = _packed(questions.coalesce(max(1, -(-n // (8 * TILE)))), ("qid",), TILE, "q").withColumn("tile", F.monotonically_increasing_id())
    return _packed(pages, keys, BLOCK, "p").crossJoin(small(tiles, TILES)).select("tile", "q_keys", "q_vectors", "p_keys", "p_vectors")


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch], width: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """tile, question keys and vectors, page keys (``width`` each) and vectors of each block and tile."""
    for batch in batches:
        tiles, qk, qv, pk, pv = (batch.column(i) for i in range(5))
        for r in range(batch.num_rows):
            q, p = (np.frombuffer(x[r].as_buffer(), np.int64) for x in (qk, pk))
            asked, said = np.frombuffer(qv[r].as_buffer(), np.float64), np.frombuffer(pv[r].as_buffer(), np.float64)
            p = p.reshape(-1, width)
            yield tiles[r].as_py(), q, asked.reshape(len(q), -1), p, said.reshape(len(p), -1)


def _products(batches: Iterator[pa.RecordBatch], width: int = 1) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]:
    """tile and strip, question keys, page keys, scores (questions x pages) of each block and strip of a tile."""
    for tile, q, asked, p, said in _pairs_of_blocks(batches, width):
        for lo in range(0, len(q), STRIP):
            scores = asked[lo : lo + STRIP] @ said.T
            yield (tile, lo), q[lo : lo + STRIP], p, np.round(scores, DIGITS, out=scores)


def best_places(keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Where the k best columns of each row are, best first, equal ones by key."""
    if scores.shape[1] <= k:
        return np.lexsort((keys, -scores), axis=1)
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
    wide = int((scores >= kth).sum(axis=1).max())  # ties of the k-th come along
    at = np.argpartition(-scores, wide - 1, axis=1)[:, :wide]
    order = np.lexsort((np.take_along_axis(keys, at, axis=1), -np.take_along_axis(scores, at, axis=1)), axis=1)[:, :k]
    return np.take_along_axis(at, order, axis=1)


def _best(keys: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = best_places(keys, scores, k)
    return np.take_along_axis(keys, at, axis=1), np.take_along_axis(scores, at, axis=1)


def _top(k: int, temperature: float | None, most: int) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}

        def told(tile: tuple[int, int]) -> pa.RecordBatch:
            q, pages, scores, mass = states.pop(tile)
            width = pages.shape[1]
            share = np.zeros(pages.shape)
            share[:, 0] = mass  # once a question and state
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(q, width), pages.ravel(), scores.ravel(), share.ravel())], names=["qid", "page", "score", "mass"])

        for tile, q, p, scores in _products(batches):
            mass = np.exp(temperature * scores).sum(axis=1) if temperature is not None else np.zeros(len(q))
            pages, best = _best(np.broadcast_to(p[:, 0], scores.shape), scores, k)
            if tile in states:
                _, had_pages, had, before = states.pop(tile)
                pages, best = _best(np.concatenate([had_pages, pages], axis=1), np.concatenate([had, best], axis=1), k)
                mass = mass + before
            elif len(states) >= most:
                yield told(next(iter(states)))
            states[tile] = (q, pages, best, mass)
        for tile in list(states):
            yield told(tile)

    return run


def top_pages(questions: DataFrame, pages: DataFrame, k: int, temperature: float | None = None) -> DataFrame:
    """qid, page, score, rank of the ``k`` pages with the largest dot product for each question; equal scores go by page.

    questions: qid, v; pages: page, v; qid and page are whole numbers. With ``temperature``, also confidence: the share of the page in the question's softmax
    over all pages at that factor.
    """
    best = _met(questions, pages).mapInArrow(_top(k, temperature, STATES * -(-TILE // STRIP)), "qid long, page long, score double, mass double")
    own = Window.partitionBy("qid")
    ranked = best.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "page")))
    if temperature is None:
        return ranked.where(F.col("rank") <= k).select("qid", "page", "score", "rank")
    shared = ranked.withColumn("confidence", F.exp(temperature * F.col("score")) / F.sum("mass").over(own))
    return shared.where(F.col("rank") <= k).select("qid", "page", "score", "rank", "confidence")


def pages_above(questions: DataFrame, pages: DataFrame, least: float) -> DataFrame:
    """qid, page, score of all pairs whose dot product is ``least`` or more; others are never rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q, p, scores in _products(batches):
            i, j = np.nonzero(scores >= least)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q[i], p[j, 0], scores[i, j])], names=["qid", "page", "score"])

    return _met(questions, pages).mapInArrow(run, "qid long, page long, score double")


def all_pairs(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """qid, page, score of every question (qid, v) and page (page, v): rows leave as the products are taken, and none is shuffled or joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q, p, scores in _products(batches):
            for i, of in enumerate(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), q[i])), pa.array(p[:, 0]), pa.array(of)], names=["qid", "page", "score"])

    return _met(questions, pages).mapInArrow(run, "qid long, page long, score double")


def best_per_page(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, page, sim, chunk_idx: the chunk (page, chunk_idx, v) of each page with the largest dot product for each question (qid, v), the first of equal ones.

    A row is a question and page, as the result is; chunks of a page that lie in several blocks meet by these rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q, p, scores in _products(batches, 2):
            order = np.lexsort((p[:, 1], p[:, 0]))
            p, scores = p[order], scores[:, order]
            starts = np.flatnonzero(np.concatenate([[True], p[1:, 0] != p[:-1, 0]]))
            most = np.maximum.reduceat(scores, starts, axis=1)
            at = np.where(scores == np.repeat(most, np.diff([*starts, len(p)]), axis=1), np.arange(len(p)), len(p))
            first = np.minimum.reduceat(at, starts, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(q, len(starts)), np.tile(p[starts, 0], len(q)), most.ravel(), p[first.ravel(), 1])], names=["qid", "page", "sim", "chunk_idx"])

    met = _met(questions, chunks, ("page", "chunk_idx")).mapInArrow(run, "qid long, page long, sim double, chunk_idx long")
    best = met.groupBy("qid", "page").agg(F.max(F.struct("sim", (-F.col("chunk_idx")).alias("c"))).alias("b"))
    return best.select("qid", "page", "b.sim", (-F.col("b.c")).alias("chunk_idx"))


def weigh_fields(question: np.ndarray, weights: np.ndarray, has: np.ndarray, fields: np.ndarray, least: np.ndarray, normalize: bool) -> tuple[np.ndarray, ...]:
    """Places of the slides that may still be among a question's best, and their score, raw sum and used weight for each question.

    question: Q x d; weights: Q x T; has: n x T, 1 where a slide has a field; fields: n x T x d, all unit vectors; ``least``: the
    score that a slide must reach for each question. Fields are added by falling weight. A cosine is 1 at most, so a slide's sum
    so far and its unused weights bound its score: what is below ``least`` for every question is dropped before its next field.
    """
    at, used, raw = np.arange(len(has)), weights @ has.T, np.zeros((len(question), len(has)))
    rest = used.copy()

    def scored(total: np.ndarray) -> np.ndarray:
        return np.where(used > 0, total / np.where(used > 0, used, 1.0), 0.0) if normalize else total

    for t in np.argsort(-weights.sum(axis=0), kind="stable"):
        own = np.flatnonzero(has[at, t])
        raw[:, own] += weights[:, t, None] * (question @ fields[at[own], t].T)
        rest -= weights[:, t, None] * has[at, t]
        alive = (scored(raw + rest) >= least[:, None] - 1e-9).any(axis=0)
        if not alive.all():
            at, used, raw, rest = at[alive], used[:, alive], raw[:, alive], rest[:, alive]
    return at, np.round(scored(raw), DIGITS), raw, used


def all_weighted(questions: DataFrame, slides: DataFrame, n_fields: int, normalize: bool = True) -> DataFrame:
    """qid, slide_id, score, raw_score, used_weight, n_matched of every question and slide, given as to ``top_weighted``; weights are positive or 0. No row is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q, asked, p, told in _pairs_of_blocks(batches):
            d = asked.shape[1] - n_fields
            has, fields = told[:, :n_fields], told[:, n_fields:].reshape(len(told), n_fields, d)
            for lo in range(0, len(q), STRIP):
                own, w = asked[lo : lo + STRIP, :d], asked[lo : lo + STRIP, d:]
                _, score, raw, used = weigh_fields(own, w, has, fields, np.full(len(own), -np.inf), normalize)
                matched = ((w > 0).astype(np.float64) @ has.T).astype(np.int32)
                for i in range(len(own)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), q[lo + i])), pa.array(p[:, 0]), *[pa.array(x[i]) for x in (score, raw, used, matched)]], names=["qid", "slide_id", "score", "raw_score", "used_weight", "n_matched"])

    return _met(questions, slides, ("slide_id",)).mapInArrow(run, "qid long, slide_id long, score double, raw_score double, used_weight double, n_matched int")


def _top_weighted(k: int, n_fields: int, normalize: bool) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for tile, all_q, all_asked, p, told in _pairs_of_blocks(batches):
            d = all_asked.shape[1] - n_fields
            for lo in range(0, len(all_q), STRIP):
                q, asked = all_q[lo : lo + STRIP], all_asked[lo : lo + STRIP]
                had = states.get((tile, lo))
                least = had[1][:, -1] if had and had[1].shape[1] == k else np.full(len(q), -np.inf)
                at, *found = weigh_fields(asked[:, :d], asked[:, d:], told[:, :n_fields], told[:, n_fields:].reshape(len(told), n_fields, d), least, normalize)
                found = [np.broadcast_to(p[at, 0], found[0].shape), *found]
                if had:
                    found = [np.concatenate(x, axis=1) for x in zip(had[:4], found, strict=True)]
                best = best_places(found[0], found[1], k)
                states[tile, lo] = (*[np.take_along_axis(x, best, axis=1) for x in found], q)
        for *found, q in states.values():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, found[0].shape[1])), *[pa.array(x.ravel()) for x in found]], names=["qid", "slide_id", "score", "raw_score", "used_weight"])

    return run


def top_weighted(questions: DataFrame, slides: DataFrame, k: int, n_fields: int, normalize: bool = True) -> DataFrame:
    """qid, slide_id, score, raw_score, used_weight, rank of the ``k`` slides with the largest weighted mean of field similarities.

    questions: qid, v (unit vector, then ``n_fields`` weights); slides: slide_id, v (1 or 0 for each field, then the fields' unit vectors,
    zeros where there is none). Slides without a field score 0. Equal scores go by slide_id. A task keeps the states of all tiles it
    meets: k x 32 bytes a question.
    """
    best = _met(questions, slides, ("slide_id",)).mapInArrow(_top_weighted(k, n_fields, normalize), "qid long, slide_id long, score double, raw_score double, used_weight double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "slide_id")))
    return ranked.where(F.col("rank") <= k)
