"""Near duplicates and components where groups are large, chained, repeated or null."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import graph, minhash


def classes(rows, size):
    """component of every doc_id by brute force; rows of one doc_id are one document."""
    sets = collections.defaultdict(list)
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d].append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for i in rng.sample(range(words), rng.choice(edits)):
            t[i] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("blocks", [(4096, 2048, 2_000_000), (16, 12, 500)])
def test_families_of_open_pairs(spark, monkeypatch, blocks):
    """Copies whose mutual similarity lies around the threshold share keys by hundreds; blocks change nothing."""
    for k, v in zip(("KEY_BLOCK", "BLOCK", "BLOCK_SHINGLES"), blocks, strict=True):
        monkeypatch.setattr(minhash, k, v)
    rng = random.Random(4)
    texts = family(rng, 150, 120, (3, 6, 8, 10, 12)) + family(rng, 60, 60, (2, 3, 4)) + family(rng, 20, 400, (5, 30))
    rows = list(enumerate(texts)) + [(900 + i, texts[i % 7]) for i in range(40)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    want = classes(rows, 2)
    assert len(set(want.values())) > 10 and got == want


def test_repeated_and_null_ids(spark):
    a, b = "one two three four five six seven eight nine ten", "k l m n o p q r s t u v w"
    rows = [(5, a), (5, a), (5, b), (3, a), (8, b), (None, a), (None, None), (9, None), (9, None)]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()), key=str)
    assert got == sorted([(5, 9, 3, False), (5, 9, 3, False), (5, 12, 3, False), (3, 9, 3, True), (8, 12, 3, False), (None, 9, None, True), (None, 0, None, True), (9, 0, 9, True), (9, 0, 9, True)], key=str)


def test_chain_and_star(spark):
    n = 3000
    chain = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("u"), ((F.col("id") + 1) * 7919 % n).alias("v"))
    star = spark.range(2000).select(F.lit(n + 500).cast("long").alias("u"), (F.col("id") + n + 1000).alias("v"))
    got = {r["node"]: r["component"] for r in graph.components(chain.unionByName(star)).collect()}
    assert got == {i: 0 for i in range(1, n)} | {n + 1000 + i: n + 500 for i in range(2000)}
    assert graph.components(chain.limit(0)).count() == 0
