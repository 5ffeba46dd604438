"""Folds and greedy operators at sizes where a square would show, and NFKD on every character."""

import random
import time
import unicodedata

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import layout, phrases
from lectern.plans.queries import IMAGE, QUERIES


def test_every_character_folds_as_in_the_standard(spark):
    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x110000))]
    said = ["a" + "".join(chars[i : i + 256]) + "z" for i in range(0, len(chars), 256)] + ["", "plain", "ẹ́x", "한글 text", "ﬁne ½ … ™ Ⅷ ㎏ 🄀"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string").repartition(8)
    got = dict(df.select("i", T.ascii_fold(F.col("t")).alias("t")).collect())
    fold = lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    assert {i: t for i, t in got.items() if t != fold(said[i])} == {}
    assert spark.sql("SELECT CAST(NULL AS string) AS t").select(T.ascii_fold(F.col("t"))).head()[0] is None


def test_cleaners_run_without_python(spark):
    t = spark.createDataFrame([("é",)], "t string")
    for name in ("clean_page_v1", "clean_page_v2", "normalize_to_ascii"):
        assert "Python" not in t.select(T.clean(F.col("t"), name))._jdf.queryExecution().executedPlan().toString()


def test_selection_of_many_candidates(spark):
    rng = random.Random(3)
    names = [f"w{i}" if i % 2 else f"two w{i}" for i in range(200)]
    e, q = [[rng.uniform(-1, 1) for _ in range(8)] for _ in names], [rng.uniform(-1, 1) for _ in range(8)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    chosen, worst = [], [None] * len(names)
    while len(chosen) < 40:
        best = max((i for i in range(len(names)) if i not in chosen), key=lambda i: (0.8 * dot(e[i], q) - (1 - 0.8) * (worst[i] if worst[i] is not None else 0.0) + 0.03 * (" " in names[i]), -i))
        chosen.append(best)
        worst = [max(dot(v, e[best]), w if w is not None else -9e9) for v, w in zip(e, worst, strict=True)]
    df = spark.createDataFrame([(names, e, q)], "n array<string>, e array<array<double>>, q array<double>")
    assert df.select(phrases.mmr(F.col("n"), F.col("e"), F.col("q"), 40)).head()[0] == chosen
    assert spark.createDataFrame([([], [], q)], df.schema).select(phrases.mmr(F.col("n"), F.col("e"), F.col("q"))).head()[0] == []


def test_rows_of_a_large_image(spark):
    n = 50_000
    df = spark.range(n).select(F.struct(F.lit("t").alias("text"), (F.col("id") % 100).cast("int").alias("x1"), (F.col("id") * 7919 % n).cast("double").alias("cy"), F.col("id").cast("int").alias("seq")).alias("s")).agg(F.collect_list("s").alias("i"))
    began = time.time()
    got = df.select(F.transform(layout.rows(F.col("i"), 18.0), F.size).alias("n")).head()["n"]
    assert time.time() - began < 60
    sizes, total, m = [], 0.0, 0
    for y in range(n):
        if m and abs(y - total / m) <= 18:
            total, m = total + y, m + 1
        else:
            sizes, total, m = sizes + [0], float(y), 1
        sizes[-1] += 1
    assert got == sizes


BOX = "image_id long, seq long, text string, x1 int, y1 int, x2 int, y2 int"


def slow_boxes(rows, least):
    kept = []
    for r in sorted(rows, key=lambda r: r[1]):
        def iou(k):
            w, h = (max(0, min(r[i + 2], k[i + 2]) - max(r[i], k[i])) for i in (3, 4))
            return w * h / (sum((b[5] - b[3]) * (b[6] - b[4]) for b in (r, k)) - w * h + 1e-6)

        if not any(k[0] == r[0] and k[2].strip().lower() == r[2].strip().lower() and iou(k) > least for k in kept):
            kept.append(r)
    return sorted(kept)


def test_boxes_against_all_kept(spark):
    for seed, least in enumerate((0.5, 0.3, 0.8, 0.1)):
        rng = random.Random(seed)
        rows = [(i % 3, i, rng.choice(["a", " A", "b"]), x := rng.randrange(-40, 40), y := rng.randrange(-40, 40), x + rng.choice([0, 1, 3, 8, 20, 30]), y + rng.choice([0, 2, 5, 9, 25])) for i in range(600)]
        got = sorted(tuple(r) for r in layout.distinct_boxes_of(spark.createDataFrame(rows, BOX), least).collect())
        assert got == slow_boxes(rows, least)
    assert layout.distinct_boxes_of(spark.createDataFrame([], BOX)).collect() == []


def test_boxes_of_a_large_image(spark):
    """100,000 boxes of one text in one image, a third of them at one place."""
    x, y = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") * 31 % 9973), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") * 17 % 7919)
    df = spark.range(100_000).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("seq"), F.lit("t").alias("text"), x.cast("int").alias("x1"), y.cast("int").alias("y1"))
    began = time.time()
    n = layout.distinct_boxes_of(df.withColumns({"x2": F.col("x1") + 30, "y2": F.col("y1") + 12})).count()
    assert time.time() - began < 60 and 1000 < n < 67_000


def test_tiles_make_the_image_again(spark, sf):
    """Every item that a tile holds is there once; the greedy rule by order of tiles is that of the plain loop."""
    got = {}
    for r in QUERIES["tiled_items"](spark, sf).collect():
        got.setdefault(r["image_id"], []).append((r["seq"], r["text"], r["x1"], r["y1"], r["x2"], r["y2"]))
    height, width = (int(n * 0.4) for n in IMAGE)
    starts = lambda n, p: sorted({*range(0, max(n - p + 1, 1), int(p * 0.8)), max(n - p, 0)})
    images = {}
    for e in spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "user_id").collect():
        images.setdefault(e[0] // 60, []).append((e[0] % 60 + 1, e[1], e[2] % 97, (e[0] % 60 + 1) % 5 * 11))
    want = {}
    for image, es in images.items():
        found = []
        for y in starts(IMAGE[0], height):
            for x in starts(IMAGE[1], width):
                found += [(s, t, a, b, a + 30, b + 9) for s, t, a, b in sorted(es) if a >= x and a + 30 <= x + width and b >= y and b + 9 <= y + height]
        kept = slow_boxes([(image, i, f[1], *f[2:]) for i, f in enumerate(found)], 0.5)
        want[image] = [(i, *k[2:]) for i, k in enumerate(sorted(kept, key=lambda k: k[1]))]
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    assert any(len(v) > 10 for v in got.values())
