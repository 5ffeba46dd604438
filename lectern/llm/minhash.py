"""Near-duplicate documents by b-bit MinHash.

1. Signatures: minima of ``BANDS * ROWS`` hash functions over a document's word shingles. Bands of them are the keys of
   candidate generation; of each minimum only the low ``BITS`` bits stay, packed into longs.
2. Documents with equal shingle sets are one class; only its representative goes on, so copies cost nothing.
3. Every band key hands its members to its smallest one: a hot key makes one pair a member, never all pairs.
4. The share of equal b-bit fields, corrected for chance collisions, estimates a pair's similarity by bit counts; pairs
   clearly below the threshold go. What is left is confirmed on the full shingle sets.
5. In keys whose members aren't all connected by then, signatures alone are compared in memory; a key hands on a forest of
   its open pairs, fewer rows than members. Members that such forests join are a cluster: a document is in one cluster,
   however many hot keys it has, so its set travels once. Clusters are settled on full sets in bounded blocks. Each pair
   of a key ends up connected, confirmed or refuted, so no link between different texts is lost.
6. Components follow from alternating stars.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import caches, durable, keep_only, small_batches, tidied
from .graph import components

#: A pair at similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 6e-7.
BANDS, ROWS, BITS = 36, 5, 2
HASHES = BANDS * ROWS
PER_LONG = 64 // BITS
EQUAL_MASK = 0x5555555555555555
THRESHOLD = 80  # percent
#: Pairs this many standard deviations of the estimate below the threshold are refuted without their sets.
DEVIATIONS = 4.2
#: Members of a key, and members and shingles of a cluster, in a block; two blocks meet in one task.
KEY_BLOCK, BLOCK, BLOCK_SHINGLES = 4096, 2048, 2_000_000
#: Rows of a similarity matrix that are made at a time.
STRIP = 256
BROADCAST_ROWS = 1_000_000
REMEMBER = 200_000

_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()
caches["minhash"] = _words.clear


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a text, A-Z lower-cased.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    if len(_words) > REMEMBER:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, n)
    k = min(size, n)
    acc = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        acc = (acc ^ (acc >> np.uint64(29))) * MIX + h[j : n - k + 1 + j]
    return np.unique(_scramble(acc))


def _minima(s: np.ndarray, rows: int = 1024) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), rows):
        made = np.multiply.outer(s[i : i + rows], MULTIPLY)
        made += ADD
        np.minimum(least, made.min(axis=0), out=least)
    return least >> np.uint64(32)


def _packed(minima: np.ndarray) -> np.ndarray:
    low = np.zeros(-(-HASHES // PER_LONG) * PER_LONG, np.uint64)
    low[:HASHES] = minima & np.uint64((1 << BITS) - 1)
    shifts = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(-1, PER_LONG) << shifts, axis=1)


def _band_keys(minima: np.ndarray) -> np.ndarray:
    bands = minima.reshape(BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        acc = _scramble(acc * MIX + bands[:, j])
    return acc


SIGNED = "doc_id long, n long, s1 long, s2 long, bands array<long>, sig array<long>"


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (128-bit hash of the set), bands, sig of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("minhash")
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])
        for batch in batches:
            n, s1, s2, bands, sigs = [], [], [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), size)
                n.append(len(s))
                if len(s):
                    m = _minima(s)
                    s1.append(_scramble(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64))
                    s2.append(np.bitwise_xor.reduce(_scramble(s * MIX)).view(np.int64))
                    bands.append(_band_keys(m).view(np.int64))
                    sigs.append(_packed(m).view(np.int64))
                else:
                    s1.append(None)
                    s2.append(None)
                    bands.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))], schema=schema)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), SIGNED)


def least_estimate() -> float:
    """The share of equal fields below which a pair can't be at the threshold."""
    s = THRESHOLD / 100
    p = s + (1 - s) / 2**BITS
    return p - DEVIATIONS * math.sqrt(p * (1 - p) / HASHES)


def equal_fields(a: Column, b: Column) -> Column:
    """Number of equal b-bit fields of two packed signatures, by bit counts. Padding fields always agree."""
    differs = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1)).bitwiseAND(F.lit(EQUAL_MASK))))
    return F.lit(HASHES) - F.aggregate(differs, F.lit(0), lambda s, x: s + x)


def _texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id and text of the documents named, written once; few ids are broadcast, counted first."""
    ids = durable(ids.distinct())
    near = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return durable(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(near, "id", "left_semi").distinct())


def confirm(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""
    texts = _texts(pairs.select(F.explode(F.array("u", "v")).alias("id")), docs)
    both = pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v").join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("minhash")
        last: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a = a.as_py() or ""
                if a != last[0]:
                    last = (a, shingle_set(a, size))
                x, y = last[1], shingle_set(b.as_py(), size)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and 100 * common >= THRESHOLD * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(tidied(run), "u long, v long").distinct()


def shingle_sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """id, s1 and set (sorted shingle hashes) of the documents named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("minhash")
        for batch in batches:
            sets = [shingle_set(t.as_py(), size) for t in batch.column(1)]
            s1 = [_scramble(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s1, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "s1", "set"])

    return _texts(ids, docs).mapInArrow(tidied(run), "id long, s1 long, set array<long>")


def _open_matrix(t: pa.Table, least: int) -> np.ndarray:
    """Which pairs of rows (sig, n, comp) are open: in different components, fit by size and by estimate."""
    sig = pc.list_flatten(t["sig"]).to_numpy().view(np.uint64).reshape(t.num_rows, -1)
    n, comp = t["n"].to_numpy(), t["comp"].to_numpy()
    made = np.zeros((len(n), len(n)), bool)
    for lo in range(0, len(n), STRIP):
        own = slice(lo, lo + STRIP)
        unequal = np.zeros((len(n[own]), len(n)), np.uint8)  # HASHES are fewer than 256
        for k in range(sig.shape[1]):
            x = sig[own, None, k] ^ sig[None, :, k]
            unequal += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(EQUAL_MASK))
        fits = (100 * n[own, None] >= THRESHOLD * n[None, :]) & (100 * n[None, :] >= THRESHOLD * n[own, None])
        made[own] = fits & (unequal <= HASHES - least) & (comp[own, None] != comp[None, :])
    return made


def _forest(least: int) -> Callable[[pa.Table], pa.Table]:
    """A spanning forest of the open pairs of a group: fewer rows than members."""

    def run(t: pa.Table) -> pa.Table:
        open_, rep = _open_matrix(t, least), t["rep"].to_numpy()
        new = open_.any(axis=1)
        us, vs = [], []
        while new.any():
            front = [int(np.argmax(new))]
            new[front] = False
            while front:
                u = front.pop()
                got = np.flatnonzero(open_[u] & new)
                new[got] = False
                front += got.tolist()
                us.append(np.full(len(got), rep[u]))
                vs.append(rep[got])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return run


def _links(least: int) -> Callable[[pa.Table], pa.Table]:
    """Confirmed links of a group, on full sets; pairs that its earlier links connect are spared."""

    def run(t: pa.Table) -> pa.Table:
        open_, rep, comp, n = _open_matrix(t, least), t["rep"].to_numpy(), t["comp"].to_pylist(), t["n"].to_numpy()
        ends = np.cumsum(n)
        ids = np.unique(pc.list_flatten(t["set"]).to_numpy(), return_inverse=True)[1]
        sets = np.split(ids, ends[:-1])
        mark = np.zeros(len(ids) + 1, bool)
        root = {c: c for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        us, vs = [], []
        for r in np.flatnonzero(open_.any(axis=1)):
            mine = find(comp[r])
            partners = [c for c in np.flatnonzero(open_[r, :r]) if find(comp[c]) != mine]
            if not partners:
                continue
            mark[sets[r]] = True
            sizes = n[partners]
            common = np.add.reduceat(mark[np.concatenate([sets[c] for c in partners])].astype(np.int64), np.cumsum(sizes) - sizes)
            mark[sets[r]] = False
            for i in np.flatnonzero(100 * common >= THRESHOLD * (n[r] + sizes - common)):
                x, y = find(comp[r]), find(comp[partners[i]])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    us.append(rep[r])
                    vs.append(rep[partners[i]])
        u, v = np.array(us, np.int64), np.array(vs, np.int64)
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return run


def _in_blocks(rows: DataFrame, blocks: str) -> DataFrame:
    """Rows dealt to pairs of blocks i < j, so that any two of a group meet; a single block or two meet once."""
    block = F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1), lambda o: (o != F.col("__b")) | (F.col(blocks) == 1))
    spread = rows.withColumn("__b", block).withColumn("__o", F.explode(others))
    return spread.withColumns({"i": F.least("__b", "__o"), "j": F.greatest("__b", "__o")}).drop("__b", "__o", blocks)


def _open_links(met: DataFrame, reps: DataFrame, found: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Step 5: confirmed links between members of a key that ``found`` leaves in different components."""
    least = math.ceil(least_estimate() * HASHES)
    placed = met.where("m > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("low < high").select("key", F.ceil(F.col("m") / KEY_BLOCK).alias("blocks"))
    dealt = _in_blocks(placed.join(mixed, "key").join(reps.select("rep", "n", "sig"), "rep"), "blocks")
    forest = durable(dealt.groupBy("key", "i", "j").applyInArrow(_forest(least), "u long, v long").distinct())
    hung = components(forest)
    clusters = hung.unionByName(hung.select(F.col("component").alias("node"), "component").distinct()).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    rows = durable(reps.select("rep", "s1", "n", "sig").join(clusters, "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("cluster", "rep", "s1", "n", "sig", F.coalesce("component", "rep").alias("comp")))
    sizes = rows.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    sets = shingle_sets(rows.select(F.col("rep").alias("id")), docs, size).withColumnRenamed("id", "rep")
    full = _in_blocks(rows.join(sizes, "cluster"), "blocks").join(sets, ["rep", "s1"])
    return durable(full.groupBy("cluster", "i", "j").applyInArrow(_links(least), "u long, v long").distinct())


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    ``size`` is the number of words of a shingle. Texts without words (null, empty, blank) have an empty set, are linked
    with nothing and kept. Rows of one doc_id count as one document. Rows without doc_id are never linked: their
    component is null and they are kept. Extra columns are ignored. component_id is the smallest doc_id reachable.
    """
    signed = durable(signatures(docs, size))
    with_set = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = durable(with_set.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")))
    alone = classes.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "rep")
    reps = durable(with_set.join(alone, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("doc_id") == F.col("rep"))).dropDuplicates(["doc_id", "s1", "s2"]).select("rep", "s1", "n", "bands", "sig"))
    least = math.ceil(least_estimate() * HASHES)
    members = reps.select("rep", F.explode("bands").alias("key"))
    leads = durable(members.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("high"), F.count("*").alias("m")).where("lead < high"))
    met = durable(members.join(leads, "key"))
    pairs = met.where("rep != lead").select(F.col("lead").alias("u"), F.col("rep").alias("v")).distinct()
    guessed = pairs.join(reps.select(F.col("rep").alias("v"), F.col("sig").alias("y"), F.col("n").alias("m")), "v").join(reps.select(F.col("rep").alias("u"), F.col("sig").alias("x"), "n"), "u")
    fits = 100 * F.least("n", "m") >= THRESHOLD * F.greatest("n", "m")
    hopeful = durable(guessed.where(fits & (equal_fields(F.col("x"), F.col("y")) >= least)).select("u", "v"))
    linked = confirm(hopeful, docs, size)
    # an id whose rows have different sets ties their classes together
    several = with_set.groupBy("doc_id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low != high").select("doc_id")
    tied = with_set.join(several, "doc_id").join(classes, ["s1", "s2"]).select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    found = components(durable(linked.unionByName(tied.where("u != v").distinct())))
    more = _open_links(met, reps, found, docs, size)
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    many = classes.where("m > 1").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "rep")
    own = signed.select("doc_id", "n", "s1", "s2").join(many, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    named = own.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """``docs`` with one document of each group, all columns kept."""
    gone = durable(near_duplicates(docs, size).where("NOT kept").select(F.col("doc_id").alias("__id")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
