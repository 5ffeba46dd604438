"""The trie against a plain dictionary of prefixes."""

import hashlib
import re
import zlib

import pytest

from lectern.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    convs = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(int(c / 20) * 20, [])[:h] + v[h:]  # remainders have the sign of c, as in SQL
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)

    below = {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        kids = children.get(k, [])
        below[k] = (sum(below[x][0] for x in kids) or 1, own + sum(below[x][1] for x in kids))
    out = set()
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), *below[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def mine(spark, rows):
    got = [tuple(r) for r in prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def talk(c, texts, role="user"):
    return [(c, i, role, x) for i, x in enumerate(texts)]


CASES = {
    "families and copies": [r for c in range(60) for r in talk(c, [f"a b {c % 3}", f"c d e {c % 2}", "same words here", f"f {c % 5}"][: 1 + c % 4])],
    "nested": [r for c in range(1, 25) for r in talk(20 * c, [f"turn {i}" for i in range(c)])] + talk(20 * 30, [f"turn {i}" for i in range(24)]),
    "absent bases": [r for c in (3, 7, 25, 26, 47, 48, 49) for r in talk(c, ["x y"] * (c % 5 + 1))],
    "nulls and ties": [(5, None, None, "b"), (5, None, None, "a"), (5, 1, "u", None), (5, 1, "u", None), (0, 0, None, None), (None, 0, "u", "gone"), (0, 0, "a", ""), (9, 2, "", " \t ")],
    "negative": [r for c in (-5, -20, -25, 20, 0) for r in talk(c, ["p q", "r", "s t"])],
    "long": [r for c in (40, 80) for r in talk(c, [f"w{i} v" for i in range(5000)])] + talk(60, ["long " * 20000, "z"]) + talk(61, ["long " * 20000, "z"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_against_plain(spark, name):
    assert mine(spark, CASES[name]) == plain(CASES[name])


def test_one_long_conversation_spans_ranges(spark):
    """A conversation that is most of the table is cut into ranges; its keys are those of an unbroken one."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = talk(20, [f"t{i % 7}" for i in range(3000)]) + talk(40, [f"t{i % 7}" for i in range(2500)]) + talk(1, ["a"])
        assert mine(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_table(spark, sf):
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {tuple(r) for r in prefix_trie(t.withColumn("depth", t["turn"]).withColumn("k1", t["turn"])).collect()}
    assert got == plain([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in t.collect()])


def test_empty(spark):
    assert mine(spark, []) == set()
