"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, where a lambda in ``use`` would evaluate it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-8))


def l2_normalize(a: Column) -> Column:
    divided = lambda v: let(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x.cast("double") / n))
    return let(a, divided)


def mean_squared_distance(a: Column, b: Column) -> Column:
    """1000 times the mean squared difference."""
    return 1000 * _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))) / F.size(a)


def softmax(a: Column) -> Column:
    return let(F.transform(a, F.exp), lambda e: let(_sum(e), lambda n: F.transform(e, lambda x: x / n)))


def intent_fold(sims: Column, temperature: float = 10.0) -> Column:
    """Softmax inside the loop: each new score re-squashes those before it, so the last one dominates."""
    return F.aggregate(sims, F.array().cast("array<double>"), lambda acc, x: softmax(F.concat(acc, F.array(temperature * x))))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of structs x1, y1, x2, y2."""
    width = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    both = (width * height).cast("double")
    return both / (area(a) + area(b) - both + 1e-6)


def tile_starts(size: Column, patch: Column, stride: Column) -> Column:
    """Starts of patches over a side, with one more that ends at the border where the stride misses it."""
    last = F.greatest(size - patch, F.lit(0))
    starts = F.sequence(F.lit(0).cast("int"), F.greatest(size - patch + 1, F.lit(1)).cast("int") - 1, stride.cast("int"))
    return F.when(F.element_at(starts, -1) != last, F.concat(starts, F.array(last.cast("int")))).otherwise(starts)
