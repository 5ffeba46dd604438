"""Block products against all pairs."""

import math
import random

import pytest

from lectern.operators import blocks as B
from lectern.operators import ranking as R


def vectors(n, d, seed, step=3):
    """Components of few values, so that scores tie."""
    rng = random.Random(seed)
    return [(i, [rng.randrange(-step, step + 1) / 2 for _ in range(d)]) for i in rng.sample(range(10 * n + 10), n)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def frames(spark, q, p):
    return spark.createDataFrame(q, "qid long, v array<double>"), spark.createDataFrame(p, "page long, v array<double>")


@pytest.fixture
def small_blocks(monkeypatch):
    """Several blocks, tiles and states that leave early."""
    for name, value in (("BLOCK", 16), ("TILE", 8), ("STATES", 2)):
        monkeypatch.setattr(B, name, value)


@pytest.mark.parametrize("k", [1, 4, 500])
def test_top_pages(spark, small_blocks, k):
    q, p = vectors(30, 3, 1), vectors(200, 3, 2)
    want = {(i, page, dot(v, w), r) for i, v in q for r, (_, page, w) in enumerate(sorted((-dot(v, w), page, w) for page, w in p)[:k], 1)}
    qs, ps = frames(spark, q, p)
    assert {tuple(r) for r in B.top_pages(qs, ps.repartition(3), k).collect()} == want
    shared = B.top_pages(qs, ps.repartition(3), k, 0.5).collect()
    assert len(shared) == len(want)
    mass = {i: sum(math.exp(0.5 * dot(v, w)) for _, w in p) for i, v in q}
    assert all(abs(r["confidence"] - math.exp(0.5 * r["score"]) / mass[r["qid"]]) < 1e-12 for r in shared)


def test_pages_above(spark, small_blocks):
    q, p = vectors(20, 3, 3), vectors(150, 3, 4)
    got = {tuple(r) for r in B.pages_above(*frames(spark, q, p), 1.25).collect()}
    assert got == {(i, page, dot(v, w)) for i, v in q for page, w in p if dot(v, w) >= 1.25}


def test_best_per_page(spark, small_blocks):
    q, p = vectors(20, 3, 5), vectors(150, 3, 6)
    chunks = [(page % 7, page, w) for page, w in p]
    asked = spark.createDataFrame(q, "qid long, v array<double>")
    got = {tuple(r) for r in B.best_per_page(asked, spark.createDataFrame(chunks, "page long, chunk_idx long, v array<double>").repartition(4)).collect()}
    want = set()
    for i, v in q:
        for g in {c[0] for c in chunks}:
            s, c = max((dot(v, w), -c) for h, c, w in chunks if h == g)
            want.add((i, g, s, -c))
    assert got == want


def test_edges(spark):
    q = [(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (3, []), (4, [None, 1.0])]
    p = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (5, [0.0, 0.0])]
    assert [tuple(r) for r in B.top_pages(*frames(spark, q, p), 5).orderBy("rank").collect()] == [(1, 1, 1.0, 1), (1, 1, 1.0, 2), (1, 5, 0.0, 3)]
    assert B.top_pages(*frames(spark, [], p), 5).collect() == []
    assert B.top_pages(*frames(spark, q, []), 5).collect() == []


def test_no_pair_of_vectors_in_the_plan(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, q_emb array<double>")
    p = spark.createDataFrame([(1, [1.0, 0.0])], "page long, emb array<double>")
    plan = R.dense(q, p, 3)._jdf.queryExecution().optimizedPlan().toString()
    cross = plan[plan.index("Join Cross") :]
    assert "v#" not in cross.splitlines()[0]
    assert cross.count("MapInArrow") == 2  # both sides are blocks before they meet


def slow_top(slides, described, weights, questions, active, k, normalize):
    unit = lambda v: [x / max(math.sqrt(sum(y * y for y in v)), 1e-12) for x in v]
    for qid, q in questions:
        told = []
        for s in slides:
            fields = [(w, dot(unit(q), unit(e)), t, x) for i, t, x, e in described if i == s and t in active and (x or "").strip() not in ("", "none") and (w := weights.get((qid, t), 0)) > 0]
            raw, used = sum(w * c for w, c, *_ in fields), sum(f[0] for f in fields)
            told.append((-round(raw / used if used and normalize else raw, 12), s, used, sorted((-w * c, active.index(t), x) for w, c, t, x in fields)))
        for r, (score, s, used, fields) in enumerate(sorted(told, key=lambda t: t[:2])[:k], 1):
            yield qid, s, r, round(-score, 9), round(used, 9), [f[2] for f in fields]


@pytest.mark.parametrize("normalize", [True, False])
def test_top_by_descriptions(spark, small_blocks, normalize):
    rng, active = random.Random(8), ("a", "b", "c", "d")
    v = lambda: [rng.gauss(0, 1) for _ in range(5)]
    slides, questions = list(range(100)), [(i, v()) for i in range(20)]
    described = [(s, t, rng.choice(["x", "y", None, "none"]), v()) for s in slides if s % 9 for t in (*active, "e") if rng.random() < 0.7]
    weights = {(i, t): rng.choice([0.0, 0.1, 0.5, 2.0]) for i, _ in questions for t in (*active, "e")}
    frame = lambda rows, s: spark.createDataFrame(rows, s).repartition(3)
    got = R.top_by_descriptions(frame([(s,) for s in slides], "slide_id long"), frame(described, "slide_id long, qtype string, text string, emb array<double>"), frame([(*key, w) for key, w in weights.items()], "qid long, qtype string, weight double"), frame(questions, "qid long, q_emb array<double>"), active, 6, normalize)
    mine = sorted((r["qid"], r["slide_id"], r["rank"], round(r["score"], 9), round(r["used_weight"], 9), [m["text"] for m in r["matched"]]) for r in got.collect())
    assert mine == sorted(slow_top(slides, described, weights, questions, active, 6, normalize))


def test_bounds_drop_slides_between_fields():
    """Slides that can't reach the least score lose their later fields, and nobody else."""
    import numpy as np

    rng = np.random.default_rng(3)
    unit = lambda *s: (lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True))(rng.normal(size=s))
    q, w, has, fields = unit(4, 8), np.tile([5.0, 1.0, 0.5], (4, 1)), np.ones((500, 3)), unit(500, 3, 8)
    every = B.weigh_fields(q, w, has, fields, np.full(4, -np.inf), True)
    least = np.sort(every[1], axis=1)[:, -5]
    at, score, _, _ = B.weigh_fields(q, w, has, fields, least, True)
    assert len(at) < 200 and len(every[0]) == 500
    assert np.array_equal(score, every[1][:, at])
    assert set(np.argsort(-every[1], axis=1)[:, :5].ravel()) <= set(at)
