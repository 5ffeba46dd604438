"""Near-duplicate documents by SimHash, joined through pivot distance tables.

1. Fingerprints: the majority of each bit over the hashes of a text's word shingles, repeats included.
2. Equal fingerprints are one class; only its smallest document goes on, so copies cost nothing.
3. A fingerprint has three segments, and fingerprints at four or fewer differing bits differ by one bit or none in one of
   them. Pivots of a segment are the reference fingerprints zero and one for each of its bits: the distances of two segments to all of them
   differ by at most one if and only if the segments do, so each segment's table of pivot distances names the few cells
   that a partner can lie in. A cell holds the segments of one table row; a segment of odd distance to zero also visits
   the cells next to it, which all have an even distance. Pairs in no common cell are discarded by their coordinates.
4. In a cell, distances to ``PIVOTS`` more references, over all 64 bits, are taken once a fingerprint. Pairs are discarded by the largest
   difference of these coordinates, one after the other; survivors are verified on their bits.
5. Cells of too many fingerprints are cut once more: in what the segment leaves of the bits, a pair agrees in one of five
   pieces. What is still too large is dealt to pairs of blocks. Each task hands on a forest of its links, fewer rows than members.
6. Components follow from alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, keep_only, small_batches, tidied
from .graph import components

SIZE, SEED = 4, 42
WITHIN = 4
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PIECES = WITHIN + 1
PIVOTS = 32
#: Fingerprints of a segment beyond which its cells are cut into pieces, and rows of a block.
CROWD, BLOCK = 128, 2048
#: Pairs compared at a time.
PAIRS = 1 << 20
#: Hashes whose bits are counted at a time.
SLICE = 1 << 14

#: References spread over the fingerprints, the same in every run.
REFERENCES = np.random.default_rng(64).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """Bits that over half of the shingle hashes have, of A-Z lower-cased words; zero without words.

    With fewer words than a shingle the whole sequence is the one shingle.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return 0
    if len(found) <= SIZE:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, counts = len(found) - SIZE + 1, np.zeros(64, np.int64)
    for lo in range(0, n, SLICE):
        a, b = starts[lo : min(lo + SLICE, n)].tolist(), ends[lo + SIZE - 1 : min(lo + SLICE, n) + SIZE - 1].tolist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("simhash")
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), "doc_id long, fp long")


def _bits(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _near(here: Column, s: int) -> Column:
    """cell, own: the cell of a segment and, where its distance to the segment's zero is odd, those next to it."""
    told = lambda at, own: F.struct((at * len(SEGMENTS) + s).cast("long").alias("cell"), F.lit(own).alias("own"))
    own = F.array(told(here, True))
    next_to = F.transform(F.array(*[F.lit(1 << b).cast("long") for b in range(SEGMENTS[s][1])]), lambda b: told(here.bitwiseXOR(b), False))
    return F.when(F.bit_count(here) % 2 == 1, F.concat(own, next_to)).otherwise(own)


def _cells(classes: DataFrame) -> DataFrame:
    """fp, cell, own of every cell that a fingerprint lies in or visits."""
    return classes.select("fp", F.inline(F.concat(*[_near(_bits(F.col("fp"), *at), s) for s, at in enumerate(SEGMENTS)])))


def _large(classes: DataFrame) -> DataFrame:
    """Cells that a crowd lies in or visits: no other can have more than ``CROWD`` rows of each of the segments next to it."""
    said = classes.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _bits(F.col("fp"), *at).alias("at")) for s, at in enumerate(SEGMENTS)])).alias("x")).select("x.s", "x.at")
    crowds = said.groupBy("s", "at").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    cells = F.when(F.col("s") == 0, _near(F.col("at"), 0)).when(F.col("s") == 1, _near(F.col("at"), 1)).otherwise(_near(F.col("at"), 2))
    return crowds.select(F.inline(cells)).select("cell").distinct()


def _piece(fp: Column, cell: Column) -> Column:
    """The pieces of the bits outside the cell's segment, each with its number."""
    made = None
    for s, (first, width) in enumerate(SEGMENTS):
        high = F.shiftrightunsigned(fp, first + width) if first + width < 64 else F.lit(0).cast("long")
        rest = F.shiftleft(high, first).bitwiseOR(_bits(fp, 0, first)) if first else high
        step = -(-(64 - width) // PIECES)
        pieces = F.array(*[_bits(rest, i * step, step) * PIECES + i for i in range(PIECES)])
        made = pieces if made is None else F.when(cell % len(SEGMENTS) == s, pieces).otherwise(made)
    return made


def _forest(fp: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of a cell: those of its own with all."""
    n = len(fp)
    order = np.argsort(~own, kind="stable")
    fp, k = fp[order], int(own.sum())
    table = np.bitwise_count(fp[:, None] ^ REFERENCES[None, :]).astype(np.int8).T.copy()
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    us, vs = [], []
    strip = max(1, PAIRS // n)
    for lo in range(0, k, strip):
        hi = min(lo + strip, k)
        near = np.abs(table[0][lo:hi, None] - table[0][None, lo:]) <= WITHIN
        near &= np.arange(lo, hi)[:, None] < np.arange(lo, n)[None, :]
        i, j = np.nonzero(near)
        i, j = i + lo, j + lo
        for t in table[1:]:
            if not len(i):
                break
            fits = np.abs(t[i] - t[j]) <= WITHIN
            i, j = i[fits], j[fits]
        linked = np.bitwise_count(fp[i] ^ fp[j]) <= WITHIN
        for x, y in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                us.append(x)
                vs.append(y)
    return fp[np.array(us, np.int64)], fp[np.array(vs, np.int64)]


def _links(dealt: DataFrame) -> DataFrame:
    """u, v: links between fingerprints of a (cell, part), group by group as the sorted rows stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("simhash")
        held: list[tuple[np.ndarray, ...]] = []

        def settle() -> pa.RecordBatch:
            cell, part, fp, own = (np.concatenate(c) for c in zip(*held, strict=True))
            starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]))
            sizes = np.diff([*starts, len(fp)])
            # a cell without one of its own, or with one alone, has no pair
            some = (sizes > 1) & np.logical_or.reduceat(own, starts)
            met = [_forest(fp[a : a + m], own[a : a + m]) for a, m in zip(starts[some].tolist(), sizes[some].tolist(), strict=True)]
            u, v = (np.concatenate([m[c] for m in met]).view(np.int64) if met else np.zeros(0, np.int64) for c in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, fp, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            rows = (cell, part, fp.view(np.uint64), own)
            last = int(np.argmax((cell == cell[-1]) & (part == part[-1])))  # where the batch's last group begins
            if last or held and (held[-1][0][-1], held[-1][1][-1]) != (cell[0], part[0]):
                if last:
                    held.append(tuple(r[:last] for r in rows))
                yield settle()
                held = []
            held.append(tuple(r[last:] for r in rows))
        if held:
            yield settle()

    placed = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part")
    return placed.select("cell", "part", "fp", "own").mapInArrow(tidied(run), "u long, v long")


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """u, v: links of distinct fingerprints (fp) that connect all whose bits differ in at most ``WITHIN`` places."""
    cells, large = _cells(classes), durable(_large(classes))
    found = _links(cells.join(large, "cell", "left_anti").select("cell", F.lit(0).cast("long").alias("part"), "fp", "own"))
    if large.isEmpty():
        return found.distinct()
    cut = durable(cells.join(large, "cell").select("fp", "own", "cell", F.explode(_piece(F.col("fp"), F.col("cell"))).alias("piece")))
    sizes = cut.groupBy("cell", "piece").agg(F.count("*").alias("m"), F.max("own").alias("owned")).where("m > 1 AND owned").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("long"))
    held = cut.join(sizes, ["cell", "piece"]).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: (o != F.col("b")) | (F.col("blocks") == 1))
    spread = held.withColumn("o", F.explode(others))
    pair = F.least("b", "o") * F.col("blocks") + F.greatest("b", "o")
    return found.unionByName(_links(spread.select("cell", (pair * (PIECES << 16) + F.col("piece") + 1).alias("part"), "fp", "own"))).distinct()


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have the fingerprint zero and are linked as any other. Rows of one doc_id count as one document.
    Rows without doc_id are never linked; their component is null. Extra columns are ignored. component_id is the smallest
    doc_id reachable, the document's own included.
    """
    made = durable(fingerprints(docs.select("doc_id", "text")))
    named = made.where("doc_id IS NOT NULL")
    classes = durable(named.groupBy("fp").agg(F.min("doc_id").alias("rep")))  # read by each pass over the cells
    linked = durable(fingerprint_links(classes.select("fp")))
    rep = classes.select("fp", "rep")
    edges = linked.join(rep.withColumnsRenamed({"fp": "u", "rep": "a"}), "u").join(rep.withColumnsRenamed({"fp": "v", "rep": "b"}), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    # an id whose rows have different fingerprints ties their classes together
    several = named.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high").select("doc_id")
    tied = named.join(several, "doc_id").join(rep, "fp").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    found = components(durable(edges.unionByName(tied).where("u != v").distinct()))
    owner = durable(rep.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    told = made.join(owner, "fp", "left")
    return told.select("doc_id", digits, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
