"""Prefix trie of conversations, built as a Patricia tree.

1. Turns are sorted by (conversation, turn) in ranges, so a conversation of any length is spread over tasks; positions and
   running keys are taken within a range and shifted by what the ranges before it hold. Texts travel once, for this sort.
2. The key of a prefix is the XOR of two independent 64-bit hashes of (position, turn) over its turns: a prefix and its
   parent differ by their last turn alone, and running keys of neighbouring ranges combine.
3. Visits of prefixes meet sorted by key. Only where their continuations differ or one ends a point of the compressed tree
   is made: branches, ends, leaves and the root. Edges between points stay compressed.
4. Whatever a subtree sums, its members sum. The smallest member of a node is also the smallest of every node further
   down its own path: each conversation owns the nodes below a certain depth, each node has one owner, and so each word
   and each leaf of a subtree is counted by exactly one of its members.
5. Unary nodes are expanded from their edge: they have the members and leaves of the point below, and save what it saves
   and the suffix of the edge's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, words

#: Conversations of a family take their first turns from the smallest number of it.
FAMILY, HEADS = 20, 4
#: At most so many prefixes are hot: those with more than that part of all visits. They are broadcast.
HOT_KEYS = 50_000
LEAST_HOT = 1000
#: Depths of an edge that are expanded in one step.
STRETCH = 4096
#: Characters of a turn that ranges are cut by.
RANGE_CHARS = 64
IN_RANGE = (1 << 33) - 1
NO_END = hashlib.sha256(b"").hexdigest()


def _mark(depth: Column, turn: tuple[Column, Column]) -> tuple[Column, Column]:
    """What a turn at ``depth`` (from 1) adds to the key of a prefix."""
    return F.xxhash64(depth.cast("long"), *turn), F.xxhash64(turn[1], depth.cast("long"), turn[0])


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, h1, h2, words of every turn, with its range and place in it."""
    said = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.withColumn("told", F.concat("role", F.lit("\0"), "text"))
    ranged = said.repartitionByRange("conv_id", "turn", F.substring("told", 1, RANGE_CHARS)).sortWithinPartitions("conv_id", "turn", "told")
    return durable(ranged.select("conv_id", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"), F.size(words(F.col("text"))).cast("long").alias("words"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(IN_RANGE).alias("n")))


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visits (conv_id, depth, k1, k2, p1, p2, total, words), one for each turn of a rebuilt conversation, and conversations
    (conv_id, len, e1, e2, total): their lengths, last keys and words."""
    turns = _sorted_turns(conversations)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = turns.groupBy("conv_id", "part").agg(F.min("n").alias("first"), F.count("*").alias("c"))
    spans = durable(spans.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))))
    place = F.col("before") + F.col("n") - F.col("first")
    bases = turns.where(F.col("conv_id") % FAMILY == 0).join(spans.where(F.col("before") < HEADS - 1), ["conv_id", "part"]).where(place < HEADS - 1)
    heads = bases.groupBy(F.col("conv_id").alias("base")).agg(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("at"), "h1", "h2", "words"))), lambda t: F.struct(t["h1"], t["h2"], t["words"])).alias("head"))
    own = spans.groupBy("conv_id").agg(F.sum("c").alias("own")).withColumns({"h": (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int"), "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    own = own.join(heads, "base", "left").withColumn("head", F.when(F.col("head").isNull(), F.array().cast(heads.schema["head"].dataType)).otherwise(F.slice("head", F.lit(1), F.col("h"))))
    marked = F.transform("head", lambda t, i: F.struct(*[m.alias(x) for m, x in zip(_mark(i + 1, (t["h1"], t["h2"])), "ab", strict=True)], t["words"].alias("words")))
    upto = lambda i, field: F.aggregate(F.slice("marked", F.lit(1), i), F.lit(0).cast("long"), lambda s, t: s + t[field] if field == "words" else s.bitwiseXOR(t[field]))
    size = F.size("head")
    own = own.withColumn("marked", marked).withColumns({"x1": upto(size, "a"), "x2": upto(size, "b"), "w0": upto(size, "words"), "shift": size - F.col("h")})
    own = durable(own.select("conv_id", "own", "h", "shift", "x1", "x2", "w0", F.transform("marked", lambda t, i: F.struct((i + 1).cast("long").alias("depth"), upto(i + 1, "a").alias("k1"), upto(i + 1, "b").alias("k2"), upto(i, "a").alias("p1"), upto(i, "b").alias("p2"), upto(i + 1, "words").alias("total"), t["words"].alias("words"))).alias("led")))
    # a conversation's own turns, with keys and words summed up within their range
    a, b = _mark(F.col("depth"), (F.col("h1"), F.col("h2")))
    tail = turns.join(spans.join(own.select("conv_id", "h", "shift"), "conv_id"), ["conv_id", "part"]).where(place >= F.col("h")).withColumn("depth", place + 1 + F.col("shift")).withColumns({"a": a, "b": b})
    running = Window.partitionBy("conv_id", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = durable(tail.select("conv_id", "part", "depth", "a", "b", "words", F.bit_xor("a").over(running).alias("r1"), F.bit_xor("b").over(running).alias("r2"), F.sum("words").over(running).alias("rw")))
    sums = durable(tail.groupBy("conv_id", "part").agg(F.bit_xor("a").alias("s1"), F.bit_xor("b").alias("s2"), F.sum("words").alias("sw")))
    none = F.lit(0).cast("long")
    starts = sums.select("conv_id", "part", *[F.coalesce(f(c).over(earlier), none).alias(o) for f, c, o in ((F.bit_xor, "s1", "o1"), (F.bit_xor, "s2", "o2"), (F.sum, "sw", "ow"))]).join(own, "conv_id")
    starts = starts.select("conv_id", "part", F.col("o1").bitwiseXOR(F.col("x1")).alias("o1"), F.col("o2").bitwiseXOR(F.col("x2")).alias("o2"), (F.col("ow") + F.col("w0")).alias("ow"))
    k1, k2 = F.col("r1").bitwiseXOR(F.col("o1")), F.col("r2").bitwiseXOR(F.col("o2"))
    kept = tail.join(starts, ["conv_id", "part"]).select("conv_id", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("a")).alias("p1"), k2.bitwiseXOR(F.col("b")).alias("p2"), (F.col("rw") + F.col("ow")).alias("total"), "words")
    visits = durable(kept.unionByName(own.select("conv_id", F.inline("led"))))
    whole = sums.groupBy("conv_id").agg(F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2"), F.sum("sw").alias("sw"))
    length = F.size("led") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    ended = own.join(whole, "conv_id", "left").select("conv_id", length.cast("long").alias("len"), F.coalesce("s1", none).bitwiseXOR(F.col("x1")).alias("e1"), F.coalesce("s2", none).bitwiseXOR(F.col("x2")).alias("e2"), (F.coalesce("sw", none) + F.col("w0")).alias("total"))
    return visits, durable(ended)


def _points(visits: DataFrame, ended: DataFrame) -> DataFrame:
    """Root, branches, ends and leaves: k1, k2, depth, n, rep, n_ends, ender, is_leaf."""
    none = F.lit(None).cast("long")
    goes_on = visits.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), "conv_id", (F.col("depth") - 1).alias("depth"))
    stops = ended.select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), none.alias("c1"), none.alias("c2"), "conv_id", F.col("len").alias("depth"))
    ends = F.col("c1").isNull()
    met = goes_on.unionByName(stops).groupBy("k1", "k2").agg(F.min("depth").alias("depth"), F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.count(F.when(ends, 1)).alias("n_ends"), F.min(F.when(ends, F.col("conv_id"))).alias("ender"), *[f(c).alias(f"{o}_{c}") for c in ("c1", "c2") for o, f in (("lo", F.min), ("hi", F.max))])
    made = met.where("n_ends > 0 OR lo_c1 != hi_c1 OR lo_c2 != hi_c2 OR depth = 0")
    return durable(made.select("k1", "k2", "depth", "n", "rep", "n_ends", "ender", (F.col("n_ends") == F.col("n")).alias("is_leaf")))


def _at_points(visits: DataFrame, ended: DataFrame, points: DataFrame) -> DataFrame:
    """The visits of points, with the point's smallest member. Hot points are few by their bound and broadcast."""
    rooted = visits.select("conv_id", "depth", "k1", "k2", "total", "words").unionByName(ended.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2", "total", "words")]))
    known = points.select("k1", "k2", "rep", "is_leaf", "n")
    bound = max(LEAST_HOT, visits.count() // HOT_KEYS)
    hot = F.broadcast(known.where(F.col("n") > bound).drop("n"))
    cold = known.where(F.col("n") <= bound).drop("n")
    rest = rooted.join(hot.select("k1", "k2"), ["k1", "k2"], "left_anti")
    return durable(rooted.join(hot, ["k1", "k2"]).unionByName(rest.join(cold, ["k1", "k2"])))


def _shared_ends(ended: DataFrame, points: DataFrame) -> DataFrame:
    """k1, k2, sha of points where several conversations end. Their numbers stream through the digest in order; a digest is
    one sequence, so a point's go through one task, which holds a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, digest = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, ids = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            done = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                key, said = (int(k1[lo]), int(k2[lo])), ",".join(map(str, ids[lo:hi].tolist())).encode()
                if key == open_:
                    digest.update(b"," + said)
                    continue
                if digest:
                    done.append((*open_, digest.hexdigest()))
                open_, digest = key, hashlib.sha256(said)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["k1", "k2", "sha"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*open_, digest.hexdigest())], names=["k1", "k2", "sha"])

    several = points.where("n_ends > 1").select("k1", "k2")
    met = ended.select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), "conv_id").join(several, ["k1", "k2"], "left_semi")
    return met.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(run, "k1 long, k2 long, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``conversations``: conv_id, turn, role, text. Rows without conv_id belong to no conversation and are left out; a null
    turn comes first; turns of equal number go by role, then text, and repeated rows are turns of their own; null role and
    text are empty. A conversation left without turns is a member of the root. Without conversations there is no node, not
    even the root. A negative number's family is that of SQL's remainder, towards zero. Texts of any length count whole; extra columns are ignored.
    """
    visits, ended = _rebuilt(conversations.select("conv_id", "turn", "role", "text"))
    points = _points(visits, ended)
    at = _at_points(visits, ended, points)
    # where a conversation's own nodes begin: below the deepest point that has a smaller member
    foreign = F.when(F.col("rep") < F.col("conv_id"), F.struct("depth", "total", "rep"))
    owners = at.groupBy("conv_id").agg(F.max(foreign).alias("o"), F.max((F.col("is_leaf") & (F.col("rep") == F.col("conv_id"))).cast("long")).alias("leaf"))
    owned = durable(ended.join(owners, "conv_id").select("conv_id", "len", "total", "leaf", F.coalesce("o.depth", F.lit(-1)).alias("above"), F.col("o.rep").alias("up"), (F.col("total") - F.coalesce("o.total", F.lit(0))).alias("tail")))
    leads = lambda c: F.max(F.when(F.col("conv_id") == F.col("rep"), F.col(c)))
    member = at.select("conv_id", "depth", "k1", "k2", "rep", (F.col("total") - F.col("words")).alias("past")).join(owned, "conv_id")
    starts = ((F.col("above") == F.col("depth")) & (F.col("len") > F.col("depth"))).cast("long")
    sums = member.groupBy("k1", "k2").agg(F.max("past").alias("past"), F.sum("total").alias("all"), F.sum("tail").alias("tails"), F.sum("leaf").alias("n_leaves"), F.sum(starts).alias("starts"), leads("total").alias("own"), leads("tail").alias("own_tail"), leads("len").alias("own_len"), leads("above").alias("above"), leads("up").alias("up"))
    said_once = F.col("own") - F.col("past") + F.col("tails") - F.col("own_tail")
    full = points.join(sums, ["k1", "k2"]).withColumns({"saved": F.col("all") - F.col("n") * F.col("past") - said_once, "n_children": F.col("starts") + (F.col("own_len") > F.col("depth")).cast("long")})
    ends = F.when(F.col("n_ends") == 0, NO_END).when(F.col("n_ends") == 1, F.sha2(F.col("ender").cast("string"), 256)).otherwise(F.col("sha"))
    down = Window.partitionBy("rep").orderBy("depth")
    tree = durable(full.join(_shared_ends(ended, points), ["k1", "k2"], "left").select("rep", "depth", "n", "n_children", "n_leaves", "saved", "past", "above", "up", ends.alias("ends"), (F.coalesce(F.lag("depth").over(down), F.col("above")) + 1).alias("top")))
    # the unary nodes of each edge
    stretches = tree.where("top < depth").withColumn("lo", F.explode(F.sequence("top", F.col("depth") - 1, F.lit(STRETCH).cast("long"))))
    unary = stretches.withColumn("at", F.explode(F.sequence("lo", F.least(F.col("lo") + STRETCH - 1, F.col("depth") - 1)))).drop("depth", "n_children", "ends")
    passed = visits.select(F.col("conv_id").alias("rep"), F.col("depth").alias("at"), (F.col("total") - F.col("words")).alias("before"))
    expanded = unary.join(passed, ["rep", "at"]).withColumn("saved", F.col("saved") + (F.col("n") - 1) * (F.col("past") - F.col("before"))).withColumns({"depth": F.col("at"), "n_children": F.lit(1).cast("long"), "ends": F.lit(NO_END)})
    columns = ("rep", "depth", "above", "up", "n", "n_children", "n_leaves", "saved", "ends")
    nodes = tree.select(*columns).unionByName(expanded.select(*columns))
    parent = F.when(F.col("depth") == F.col("above") + 1, F.col("up")).otherwise(F.col("rep"))
    return nodes.select(F.col("rep").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
