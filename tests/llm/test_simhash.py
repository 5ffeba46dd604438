"""SimHash groups against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from lectern.llm import simhash as S

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def slow_groups(fps):
    """Smallest number reachable of each fingerprint of a list of (number, fingerprint)."""
    low = {i: i for i, _ in fps}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for k, (i, f) in enumerate(fps):
        for j, g in fps[:k]:
            if (f ^ g).bit_count() <= 4:
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in fps}


def test_fingerprint():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "One", "a b c", "a b c d", "A B C D E", "é É ß x y z q", "x " * 40, "\x1c a \x85 b c d e"]
    texts += [" ".join(rng.choice(["cat", "Dog", "über", "x"]) for _ in range(rng.randrange(200))) for _ in range(50)]
    assert [S.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    long = "w " * 3 + " ".join(str(i) for i in range(2 * S.SLICE))
    assert S.fingerprint(long) == slow_fingerprint(long)


def clusters(n, seed):
    """Random fingerprints, each with some at up to six bits, in all segments."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        f = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        out.append(f)
        for _ in range(4):
            for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
                f ^= 1 << int(b)
            out.append(f)
    return list(dict.fromkeys(out))


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def components_of(spark, fps):
    rows = S.fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    at = {signed(f): i for i, f in enumerate(fps)}
    low = list(range(len(fps)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for u, v in rows:
        assert (fps[at[u]] ^ fps[at[v]]).bit_count() <= 4
        a, b = find(at[u]), find(at[v])
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(fps))}


@pytest.mark.parametrize("seed", range(3))
def test_links(spark, seed):
    fps = clusters(150, seed)
    assert components_of(spark, fps) == slow_groups(list(enumerate(fps)))


def test_links_of_large_cells(spark, monkeypatch):
    """Cells beyond the bound are cut into pieces and blocks; no link is lost."""
    monkeypatch.setattr(S, "CROWD", 3)
    monkeypatch.setattr(S, "BLOCK", 8)
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 1 << 64, dtype=np.uint64))
    fps = clusters(40, 7) + [base ^ int(sum(1 << int(b) for b in rng.choice(64, 5, replace=False))) for _ in range(150)] + [base & ~((1 << 40) - 1) | int(x) for x in rng.integers(0, 1 << 40, 200)]
    fps = list(dict.fromkeys(fps))
    assert components_of(spark, fps) == slow_groups(list(enumerate(fps)))


def test_every_distance_meets(spark):
    """A pair for each way that four bits can fall into the segments."""
    rng = random.Random(2)
    fps = []
    for _ in range(120):
        f = rng.getrandbits(64)
        fps += [f, f ^ sum(1 << b for b in rng.sample(range(64), 4))]
    found = components_of(spark, fps)
    assert all(found[2 * i] == found[2 * i + 1] for i in range(120))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (None, None), (7, "x y z"), (7, "p q r s t"), (9, "P q R s t"), (9, "P q R s t"), (10, "x y z")]
    t = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "doc_id AS fp", "text AS rep")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.simhash_groups(t).collect()), key=str)
    at = {1: 1, 2: 1, 3: 1, 7: 7, 9: 7, 10: 7, None: None}
    assert got == sorted(((i, f"{slow_fingerprint(x):016x}", at[i]) for i, x in rows), key=str)
    assert S.simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    said = sorted((r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect())
    want = slow_groups(said)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.simhash_groups(docs).collect()}
    assert got == {(i, f"{f:016x}", want[i]) for i, f in said}
