"""What a query keeps in memory, ships and shuffles stays in bounds as its tables grow."""

import difflib
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions import splitting as P
from lectern.functions import text as T
from lectern.operators import blocks as B
from lectern.operators import index as I
from lectern.operators import ranking as R
from lectern.operators import titles
from lectern.plans.models import letters26
from lectern.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_titles_are_never_broadcast(spark, monkeypatch):
    """Titles can be whole texts: blocks are bounded by letters, and no join sends them to the driver."""
    monkeypatch.setattr(titles, "CHARS", 5_000)
    names = [f"{'word ' * 300}{i} a{i * 7919} b" for i in range(40)]
    first = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "entry_key string, ord long")
    rest = spark.createDataFrame([(n[:-2] + "c", i) for i, n in enumerate(names)], "key string, id long")
    found = titles.search(rest, first)
    assert "CartesianProduct" in plan(found) and "Broadcast" not in plan(found)
    packed = titles._packed(first, ("entry_key", "ord"), titles.BLOCK, "e").collect()
    assert max(sum(map(len, r["e_entry_key"])) for r in packed) <= 5_000 and sum(len(r["e_ord"]) for r in packed) == 40
    best = found.groupBy("id").agg({"score": "max"}).collect()
    assert len(best) == 40 and all(r[1] > 0.99 for r in best)


def test_comparisons_stop_early(monkeypatch):
    """Matching blocks are difflib's, short or with popular letters, and a hopeless pair is left once its first blocks are known."""
    rng = random.Random(8)
    seen = []
    monkeypatch.setattr(titles, "heappop", lambda todo, pop=titles.heappop: seen.append(1) or pop(todo))
    for n in range(600):
        letters = ("a", "ab", "abc ", "abcdefghijklmnopqrstuvwxyz 0123456789")[n % 4]
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(2))
        b = b if n % 3 else b[:50] + a[20:200] + "xqz" * (n % 5) + a[250:]
        of = difflib.SequenceMatcher(None, a, b).ratio()
        assert titles.ratio(a, b) == of
        for least in (of, rng.random()):
            letters_ = titles.matched(a, titles.places(a), b, *titles.anchors(b), least)
            assert letters_ is None if of < least else not a + b or 2.0 * letters_ / len(a + b) == of
    a, b = "and and or " * 60, "a longer study of words and of numbers in deep networks for all who read it " * 2
    all_of_it, few = [], []
    for least, told in ((0.0, all_of_it), (0.3, few)):
        seen.clear()
        titles.matched(a, titles.places(a), b, *titles.anchors(b), least)
        told.extend(seen)
    assert 4 * len(few) < len(all_of_it)


def test_fold_looks_at_each_letter_once(spark):
    """The text is made once, a letter meets the class of odd ones only if it isn't ASCII, and every code point folds as NFKD."""
    points = [chr(c) for c in (*range(1, 0xD800, 7), *range(0xE000, 0x20000, 5), *range(0x1F100, 0x1F270), *range(0x2000, 0x2600))]
    texts = [g.join(points[i : i + 97]) for g in ("", "a") for i in range(0, len(points), 97)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.ascii_fold(F.regexp_replace("t", "\x00", "")).alias("f"))
    assert all(r["f"] == (None if r["t"] is None else unicodedata.normalize("NFKD", r["t"]).encode("ascii", "ignore").decode()) for r in df.collect())
    said = df._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("\x00") == 1
    assert len(T._class(T._folds()[1])) < 4_000


def test_chunks_are_made_once(spark, sf):
    """Rows of chunks don't bring a filter that makes all chunks again, and a reference is looked for once."""
    said = QUERIES["chunk_records"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert said.count(r"Source:\s*(") == 1, said.count(r"Source:\s*(")


def test_texts_are_cleaned_once(spark, sf):
    """Patterns run on texts that can match, collapsed white space is collapsed again only where two blanks are, and a description is cleaned once."""
    odd = ["1 a.  1b. 2 C\u3000\u2003\nD. \u2022 x", "12. 11 A. 10 B! 0 (c) [ d ] ( / ) ( ) e.. f-- g", " Source:\tA  Source: b", "x\u00a8\u00a8y \u00a0 z\u0085", "a b a b a b a b", "it didn't doesn http://  a / b", "", None, "\r\n\t", "one\r\ntwo\tthree\x1cfour"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    space = "[" + T.SPACE + "]+"
    plain = [None if t is None else re.sub(space, " ", t).strip(" ") for t in odd]
    assert [r[0] for r in df.select(T.apply(F.col("t"), T.CHUNK)).collect()] == plain
    for steps in (T.PAGE_V1, T.PAGE_V2, T.BODY_V2, T.TITLE_V2):
        one_by_one = F.col("t")
        for step in steps:
            one_by_one = T.apply(one_by_one, (step,))
        assert all(r[0] == r[1] for r in df.select(T.apply(F.col("t"), steps), one_by_one).collect())
    cut = lambda t: [p for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9(\[])|(?<=\.)\s+(?=\u2022)", t) if p]
    assert [r[0] for r in df.where("t IS NOT NULL").select(P.sentences(F.col("t"))).collect()] == [cut(t) for t in plain if t is not None]
    said = QUERIES["slide_records"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("(?<=[.!?]") <= 5 and "(?<=[.!?])\\s+" not in said, said.count("(?<=[.!?]")


def test_pairs_are_neither_shuffled_nor_joined(spark, sf):
    """What every question and every page or slide give leaves the tasks that made it."""
    for name in ("blend_scores", "weighted_qadesc_rank"):
        said = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        above = said[: said.index("MapInArrow")]
        assert "Join" not in above and "Aggregate" not in above and "Window" not in above, name


def test_missing_vectors_have_no_score_but_rows(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0]), (50, None)], "qid long, q_emb array<double>")
    p = spark.createDataFrame([(1, "long enough a text", [1.0, 0.0], [0.0, 1.0]), (2, "short", [3.0, 4.0], [4.0, 3.0]), (3, "short", None, None)], "page long, text string, desc_emb array<double>, text_emb array<double>")
    got = {(r["qid"], r["page"]): r["score"] for r in R.blended(q, p).collect()}
    assert got == {(0, 1): 0.4, (0, 2): 0.6, (0, 3): None, (50, 1): None, (50, 2): None, (50, 3): None}


def test_products_and_batches_are_bounded(spark, sf, monkeypatch):
    """A task scores a strip of a tile at a time, blocks of long vectors have fewer rows, and Arrow batches are small."""
    monkeypatch.setattr(B, "BYTES", 64_000)
    wide = spark.range(0, 300, 1, 1).select(F.col("id").alias("slide_id"), F.array_repeat(F.lit(1.0), 585).alias("v"))
    assert max(len(r["p_vectors"]) for r in B._packed(wide, ("slide_id",), B.BLOCK, "p").collect()) <= 64_000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    n, m, d = 700, 50, 3
    row = pa.RecordBatch.from_arrays([pa.array([0]), *[pa.array([x.tobytes()], pa.binary()) for x in (np.arange(n), np.ones((n, d)), np.arange(m), np.ones((m, d)))]], names=list("abcde"))
    parts = list(B._products(iter([row])))
    assert [len(p[1]) for p in parts] == [256, 256, 188] and all(p[3].shape == (len(p[1]), m) for p in parts)


def test_only_pages_found_travel(spark):
    """Chunks and pages that no question has found are filtered where they are read, not shuffled."""
    v = lambda i: [float(i % 7 + 1), float(i % 5), 1.0]
    q = spark.createDataFrame([(1, "how many words", v(1))], "qid long, question string, q_emb array<double>")
    fields = ("title", "body", "imgtext", "desc")
    p = spark.createDataFrame([(i, *["text"] * 4, *[v(i)] * 4) for i in range(50)], "page long, " + ", ".join(f"{f} string" for f in fields) + ", " + ", ".join(f"{f}_emb array<double>" for f in fields))
    c = spark.createDataFrame([(i, j, f"chunk {j}", v(i + j)) for i in range(50) for j in range(3)], "page long, chunk_idx int, text string, chunk_emb array<double>")
    told = R.two_stage(q, p, c, candidates=4)
    assert told.count() == 4
    said = told._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("LeftSemi") >= 3 and "rightHint=(strategy=broadcast)" in said


def test_columns_come_along_without_a_join(spark):
    slides = spark.createDataFrame([(0, "en", "t", "One two three. Four five six.", "", ""), (1, None, "t", "One two three.", "", "")], "slide_key long, lang string, title string, body string, imgtext string, desc string")
    for made in (I.index_pages, I.index_chunks):
        df = made(slides, letters26, keep=("lang",))
        assert {(r["page"], r["lang"]) for r in df.collect()} == {(1, "en"), (2, None)} and "Join" not in plan(df)
