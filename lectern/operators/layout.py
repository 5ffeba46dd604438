"""Layout of pages and recognised text: reading order, rows, duplicate boxes, tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import CHUNK, apply, clean, strip

FAR = 1e9


def _origin(b: Column) -> Column:
    """The origin of the first line whose first span has one: other spans don't count."""
    firsts = F.transform(F.filter(b["lines"], lambda l: F.size(l["spans"]) > 0), lambda l: F.get(l["spans"], F.lit(0))["origin"])  # noqa: E741
    return F.get(F.filter(firsts, lambda o: o.isNotNull()), F.lit(0))


def text_blocks(blocks: Column) -> Column:
    """text, origin, block_idx of the text blocks (type 0) of a page; numbered before they are put in reading order."""
    def line(l: Column) -> Column:  # noqa: E741
        return F.array_join(F.transform(l["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), "")

    said = lambda b: apply(F.array_join(F.transform(F.filter(F.transform(b["lines"], line), lambda t: F.trim(t) != ""), lambda t: F.concat(t, F.lit(" "))), ""), CHUNK)
    kept = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == 0), lambda b: F.struct(said(b).alias("text"), _origin(b).alias("origin"))), lambda b: b["text"] != "")
    numbered = F.transform(kept, lambda b, i: F.struct(F.coalesce(F.get(b["origin"], F.lit(1)), F.lit(FAR)).alias("y"), F.coalesce(F.get(b["origin"], F.lit(0)), F.lit(FAR)).alias("x"), i.alias("block_idx"), b["text"].alias("text"), b["origin"].alias("origin")))
    return F.transform(F.array_sort(numbered), lambda b: F.struct(b["text"], b["origin"], b["block_idx"]))


def merged_text(made: Column) -> Column:
    """The texts of ``text_blocks`` one below the other."""
    return F.array_join(F.transform(F.filter(made, lambda b: b["text"] != ""), lambda b: b["text"]), "\n")


def text_of_blocks(blocks: Column) -> Column:
    """The older form: whole texts of located blocks in reading order, each with a line end; nothing is cleaned."""
    line = lambda l: F.concat(F.array_join(F.transform(l["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), ""), F.lit(" "))
    said = lambda b: strip(F.array_join(F.transform(F.filter(b["lines"], lambda l: F.size(l["spans"]) > 0), line), ""))
    located = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == 0), lambda b: F.struct(said(b).alias("text"), _origin(b).alias("o"))), lambda b: b["o"].isNotNull() & (b["text"] != ""))
    ordered = F.array_sort(F.transform(located, lambda b, i: F.struct(F.get(b["o"], F.lit(1)).alias("y"), F.get(b["o"], F.lit(0)).alias("x"), i.alias("i"), b["text"].alias("text"))))
    return F.array_join(F.transform(ordered, lambda b: F.concat(b["text"], F.lit("\n"))), "")


def images(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["type"] == 1)


def rows(items: Column, threshold: float = 100.0) -> Column:
    """Items (text, x1, cy, seq ...) as rows, top to bottom, each left to right.

    An item joins the current row while its centre lies within ``threshold`` of the row's running mean.
    """
    ordered = F.array_sort(F.transform(items, lambda t: F.struct(t["cy"].cast("double").alias("cy"), t["x1"].alias("x1"), t["seq"].alias("seq"), t["text"].alias("text"))))
    # the fold keeps where rows start, not their items
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(acc: Column, t: Column) -> Column:
        opens = (acc["n"] == 0) | (F.abs(t["cy"] - acc["sum"] / F.greatest(acc["n"], F.lit(1))) > threshold)
        starts = F.when(opens, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"])
        return F.struct(starts.alias("starts"), F.when(opens, t["cy"]).otherwise(acc["sum"] + t["cy"]).alias("sum"), F.when(opens, 1).otherwise(acc["n"] + 1).alias("n"), (acc["i"] + 1).alias("i"))

    def cut(o: Column) -> Column:
        across = lambda r: F.array_sort(F.transform(r, lambda t: F.struct(t["x1"], t["cy"], t["seq"], t["text"])))
        return V.let(F.aggregate(o, start, step, lambda acc: acc["starts"]), lambda starts: F.transform(starts, lambda s, k: across(F.slice(o, s + 1, F.coalesce(F.get(starts, k + 1), F.size(o)) - s))))

    return V.let(ordered, cut)


def rows_to_lines(grouped: Column, cleaned: bool = False) -> Column:
    said = F.transform(grouped, lambda r: F.array_join(F.transform(r, lambda t: t["text"]), " "))
    return F.transform(F.filter(said, lambda x: F.trim(x) != ""), lambda x: clean(x, "clean_page_v2")) if cleaned else said


def distinct_boxes(items: Column, threshold: float = 0.5) -> Column:
    """Items without those of the same text that overlap an item kept before them; for the few items of a column."""
    key = lambda t: F.lower(F.trim(t["text"]))

    def step(kept: Column, t: Column) -> Column:
        seen = lambda k: F.exists(kept, lambda x: (key(x) == k) & (V.iou(t, x) > threshold))
        return F.when(V.let(key(t), seen), kept).otherwise(F.concat(kept, F.array(t)))

    return F.aggregate(items, F.slice(items, 1, 0), step)


class _Kept:
    """Kept boxes in a grid for each size class, so that a box meets the few that can overlap it enough.

    Boxes with an overlap over t have widths and heights within a factor t, and centres within 1 - t of the larger side: sizes are
    classed by powers of two, and cells are as large as their class. Boxes that are kept overlap each other little, so a cell holds few.
    """

    def __init__(self, threshold: float) -> None:
        self.least, self.near = threshold, math.ceil(-math.log2(threshold))
        self.cells: dict[tuple[int, int, int, int], list[tuple]] = {}

    def add(self, x1: float, y1: float, x2: float, y2: float) -> bool:
        """Whether the box is kept. A box without area overlaps nothing."""
        w, h = x2 - x1, y2 - y1
        if w <= 0 or h <= 0:
            return True
        p, q, cx, cy = math.floor(math.log2(w)), math.floor(math.log2(h)), (x1 + x2) / 2, (y1 + y2) / 2

        def cells(centre: float, own: int, other: int) -> range:
            reach = (1 - self.least) * 2.0 ** (max(own, other) + 1)
            return range(math.floor((centre - reach) / 2.0**other), math.floor((centre + reach) / 2.0**other) + 1)

        for a in range(p - self.near, p + self.near + 1):
            for b in range(q - self.near, q + self.near + 1):
                for i in cells(cx, p, a):
                    for j in cells(cy, q, b):
                        for u1, v1, u2, v2 in self.cells.get((a, b, i, j), ()):
                            both = max(0, min(x2, u2) - max(x1, u1)) * max(0, min(y2, v2) - max(y1, v1))
                            if both / (w * h + (u2 - u1) * (v2 - v1) - both + 1e-6) > self.least:
                                return False
        self.cells.setdefault((p, q, math.floor(cx / 2.0**p), math.floor(cy / 2.0**q)), []).append((x1, y1, x2, y2))
        return True


def distinct_boxes_of(boxes: DataFrame, threshold: float = 0.5, order: str = "seq") -> DataFrame:
    """Boxes (image_id, ``order``, text, x1, y1, x2, y2 ...) without those that overlap a box of the same image and text kept before them.

    An image's boxes of one text stream by in order, and each meets kept boxes of its cells alone: the work grows with their number,
    and a task holds the kept boxes of one group.
    """
    if not 0 < threshold < 1:
        raise ValueError("the least overlap lies between 0 and 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, _Kept(threshold)
        for batch in batches:
            stays = []
            for own, *box in zip(*[batch.column(c).to_pylist() for c in ("__group", "x1", "y1", "x2", "y2")], strict=True):
                if own != group:
                    group, kept = own, _Kept(threshold)
                stays.append(kept.add(*box))
            yield batch.filter(pa.array(stays, pa.bool_())).drop_columns(["__group"])

    grouped = boxes.withColumn("__group", F.struct("image_id", F.lower(F.trim("text")).alias("text")))
    return grouped.repartition("__group").sortWithinPartitions("__group", order).mapInArrow(run, boxes.schema)


def tiles(height: Column, width: Column, share: float = 0.4, overlap: float = 0.8) -> Column:
    """(y, x) of every tile of an image; tiles are a share of it and strides a share of a tile."""
    ph, pw = F.floor(height * share).cast("int"), F.floor(width * share).cast("int")
    ys = V.tile_starts(height, ph, F.floor(ph * overlap).cast("int"))
    xs = V.tile_starts(width, pw, F.floor(pw * overlap).cast("int"))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y"), x.alias("x")))))


def tiled_items(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, items of whole images from (image_id, tile, y, x, items) of their tiles.

    Items (text, bbox, x1, y1, x2, y2, cx, cy) move by the place of their tile; of duplicates, which overlapping tiles see
    twice, the first in order of tiles stays. A tile without items adds nothing.
    """
    moved = F.transform("items", lambda t: F.struct(
        t["text"].alias("text"), F.transform(t["bbox"], lambda p, i: F.when(i % 2 == 0, p + F.col("x")).otherwise(p + F.col("y"))).alias("bbox"),
        (t["x1"] + F.col("x")).alias("x1"), (t["y1"] + F.col("y")).alias("y1"), (t["x2"] + F.col("x")).alias("x2"), (t["y2"] + F.col("y")).alias("y2"), (t["cx"] + F.col("x")).alias("cx"), (t["cy"] + F.col("y")).alias("cy"),
    ))
    each = found.select("image_id", "tile", F.posexplode(moved).alias("at", "item")).select("image_id", (F.col("tile").cast("long") * (1 << 31) + F.col("at")).alias("place"), "item")
    kept = distinct_boxes_of(each.select("image_id", "place", "item.text", *[F.col(f"item.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]), threshold, "place")
    whole = each.join(kept.select("image_id", "place"), ["image_id", "place"])
    listed = whole.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("t"))
    found_any = found.select("image_id").distinct().join(listed, "image_id", "left")
    made = F.transform("t", lambda t, i: t["item"].withField("seq", i))
    return found_any.select("image_id", F.coalesce(made, F.array().cast(_type_of(listed.select(made.alias("m"))))).alias("items"))


def _type_of(df: DataFrame) -> object:
    return df.schema[0].dataType


def image_rows(items: Column, threshold: float = 100.0) -> Column:
    return rows(items, threshold)


def image_text(items: Column, threshold: float = 100.0) -> Column:
    """The text of an image, a line a row."""
    return F.array_join(rows_to_lines(rows(items, threshold)), "\n")


def image_lines(items: Column, threshold: float = 100.0) -> Column:
    """The cleaned lines of an image."""
    return rows_to_lines(rows(items, threshold), cleaned=True)
