"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted the same number of times, target / source size, which is rarely whole. Whole parts
are certain; the fractions are settled by the pivotal method: two documents of like size meet, one random transfer of
probability mass makes one of them integral, the other goes on with the rest. Blocks of documents run it side by side
and each leaves one open document at most; the open ones meet again in a reduction tree until one a source is left.
Sums stay fixed in every meeting, so each source's words come near its target.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_GAP, durable

#: Repeating weights of the sources in order of their names, null last.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's target stops at so many times its size.
MAX_REPEAT = 3.0
#: Documents that one task settles in a sitting, and open documents that meet at each level of the tree.
BLOCK = 4096
SEED = 17
#: At most so many ids with their copies (16 bytes each, 16 MB) are broadcast, counted first; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def n_words(text: Column) -> Column:
    """Words of a text without building their array: the gaps between them, by the marks of a shortened text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(trimmed, WORD_GAP, "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Add ``target`` to one row a source (source, source_size).

    Water filling in closed form: sources ordered by the level at which they are full; the first level that the next
    source's does not undercut is the common one.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", max_repeat * F.col("source_size")).withColumn("full", F.col("cap") / F.col("w"))
    by_full = everything.orderBy("full", F.col("source").asc_nulls_last())
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open_w", F.sum("w").over(by_full.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", F.when(F.col("rest") / F.col("open_w") <= F.col("full"), F.col("rest") / F.col("open_w")))
    # the first source that isn't full sets the level for itself and all after it
    t = t.withColumn("level", F.first("level", ignorenulls=True).over(by_full.rowsBetween(Window.unboundedPreceding, 0)))
    return t.select(*sizes.columns, F.coalesce(F.least(F.col("level") * F.col("w"), "cap"), "cap").alias("target"))


def _unit(*parts: object) -> float:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest(), "big") / float(1 << 56)


def _settle(pdf: pd.DataFrame, seed: int, level: int, last: bool) -> pd.DataFrame:
    """Pivotal rounding of one block, largest documents first, so that a small one is left open with its fraction."""
    pdf = pdf.sort_values(["__size", "__id", "__tie"], kind="stable", na_position="last", ascending=[False, True, True]).reset_index(drop=True)
    p = pdf["__p"].tolist()
    ids = pdf["__id"].tolist()
    tol = 1e-9
    held = -1
    for i in range(len(p)):
        if p[i] <= tol or p[i] >= 1 - tol:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = p[held], p[i]
        u = _unit(seed, level, ids[held], ids[i], i)
        if a + b < 1:
            # all mass goes to one of the two
            if u * (a + b) < a:
                p[held], p[i] = a + b, 0.0
            else:
                p[held], p[i] = 0.0, a + b
        elif u * (2 - a - b) < 1 - b:
            p[held], p[i] = 1.0, a + b - 1
        else:
            p[held], p[i] = a + b - 1, 1.0
        still = [j for j in (held, i) if tol < p[j] < 1 - tol]
        for j in {held, i} - {*still}:
            p[j] = float(round(p[j]))
        held = still[0] if still else -1
    if held >= 0 and last:
        p[held] = 1.0 if _unit(seed, "last", ids[held]) < p[held] else 0.0
        held = -1
    pdf["__p"] = p
    pdf["__open"] = [j == held for j in range(len(p))]
    return pdf


def _settler(seed: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        return _settle(pdf, seed, level, last)

    return settle


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every row of ``docs`` (doc_id, source, text).

    Null text has size 0; documents of size 0 take no part and get 0 copies. Null source is one source, ordered last.
    Repeated rows count and are settled each. Extra columns are ignored. The outcome depends on doc_id, source, size
    and seed only, not on partitions, so a recomputed task repeats its choices. ``copies`` never exceeds max_repeat.
    """
    sized = durable(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    grouped = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("__n"))
    per_source = durable(targets(grouped, weights, max_repeat))
    s = per_source.select(F.col("source").alias("__s"), "source_size", "target", "__n")
    known = sized.join(s, sized["source"].eqNullSafe(s["__s"])).drop("__s")
    share = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(max_repeat))).otherwise(0.0)
    known = known.withColumn("__c", share).withColumn("__whole", F.floor(F.col("__c") + 1e-9)).withColumn("__p", F.greatest(F.col("__c") - F.col("__whole"), F.lit(0.0)))
    # blocks by a hash of the id: the same whatever the partitions, and no source is too large for its blocks
    open_ = known.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "source_size", "target", F.col("__whole").cast("long").alias("__whole"), "__p", F.xxhash64("doc_id", "size").alias("__tie"), F.ceil(F.col("__n") / block).alias("__blocks"))
    open_ = open_.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), F.col("__id"), F.col("__size")), F.greatest("__blocks", F.lit(1))))
    schema = open_.schema
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", __open boolean"
    done: DataFrame | None = None
    level = 0
    blocks = per_source.agg(F.max(F.ceil(F.col("__n") / block))).collect()[0][0] or 1
    while True:
        last = blocks <= 1
        settled = durable(open_.groupBy("__source", "__block").applyInPandas(_settler(seed, level, last), out_schema))
        over = settled.where(~F.col("__open")).drop("__open")
        done = over if done is None else done.unionByName(over)
        if last:
            break
        blocks = -(-blocks // block)
        level += 1
        open_ = settled.where("__open").drop("__open").withColumn("__block", F.floor(F.col("__block") / block).cast("long"))
    return done.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", (F.col("__whole") + F.round("__p").cast("long")).alias("copies"))


def mix_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns, whatever their names.

    Null and blank texts have no words and so no copy; an empty table gives an empty result.
    Rows of one doc_id are matched to their decisions by their order, so repeated rows keep their own.
    """
    same = Window.partitionBy("doc_id")
    nth = lambda size: F.row_number().over(same.orderBy(size, F.xxhash64("source")))
    chosen = mix(docs, **options)
    chosen = durable(chosen.select(F.col("doc_id").alias("__id"), F.col("copies").alias("__copies"), nth(F.col("size")).alias("__n"), F.count("*").over(same).alias("__m")))
    of = lambda a, b: a["doc_id"].eqNullSafe(b["__id"])
    # an id that occurs once needs no order: beyond the bound its text is shuffled for the join, and only for that
    once = chosen.where("__m = 1 AND __copies > 0").select("__id", "__copies")
    once = F.broadcast(once) if once.count() <= BROADCAST_ROWS else once
    taken = docs.join(once, of(docs, once)).select(*[docs[c] for c in docs.columns], "__copies")
    repeated = chosen.where("__m > 1").select("__id").distinct()
    if n := repeated.count():
        found = docs.join(F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated, of(docs, repeated), "left_semi")
        mine, more = found.withColumn("__nth", nth(n_words(F.col("text")))), chosen.where("__m > 1 AND __copies > 0")
        taken = taken.unionByName(mine.join(more, of(mine, more) & (mine["__nth"] == more["__n"])).select(*[mine[c] for c in docs.columns], "__copies"))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
