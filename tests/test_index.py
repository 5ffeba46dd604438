"""Indexing, keywords and the search for papers against short loops; every service is a fake."""

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import or_empty_mark
from lectern.operators import index, tables
from lectern.plans.models import letters26
from lectern.plans.queries import QUERIES
from lectern.sources import files


def test_pages_and_chunks(spark):
    rows = [("0", " A\n title ", "one two three. four five six", None, "d"), ("1", None, "", "seen on the picture", ""), ("2", "x", None, None, None)]
    slides = spark.createDataFrame(rows, "slide_key string, title string, body string, imgtext string, `desc` string")
    pages = {r["page"]: r for r in index.index_pages(slides, letters26).collect()}
    assert [(p, pages[p]["title"], pages[p]["body"], pages[p]["imgtext"], pages[p]["desc"]) for p in sorted(pages)] == [(1, "A title", "one two three. four five six", "", "d"), (2, "", "", "seen on the picture", ""), (3, "x", "", "", "")]
    empty = spark.range(1).select(letters26(or_empty_mark(F.lit("")))).head()[0]
    assert pages[3]["body_emb"] == empty and pages[2]["title_emb"] == empty and pages[1]["title_emb"] != empty
    chunks = sorted((r["page"], r["chunk_idx"], r["text"]) for r in index.index_chunks(slides, letters26).collect())
    assert chunks == [(1, 0, "one two three."), (1, 1, "four five six"), (2, 0, "seen on the picture")]
    assert index.index_chunks(slides.limit(0), letters26).count() == 0


def test_descriptions(spark):
    rows = [(1, {"what": " N/A ", "why": " because ", "how": "so"}), (2, {}), (3, None), (4, {"why": None})]
    got = index.description_vectors(spark.createDataFrame(rows, "slide_id int, qa_descs map<string,string>"), ("what", "why"), letters26)
    assert [(r["slide_id"], r["qtype"], r["text"]) for r in got.collect()] == [(1, "why", "because")]


def test_semantic_keywords(spark):
    tok = lambda i, t, lemma, pos, dep, head, stop=False: (i, t, lemma, pos, dep, head, stop, False, False)
    tokens = [tok(0, "Models", "model", "NOUN", "nsubj", 1), tok(1, "share", "share", "VERB", "ROOT", 1), tok(2, "the", "the", "DET", "det", 3, True), tok(3, "weights", "weight", "NOUN", "dobj", 1)]
    schema = "qid int, question string, tokens array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head:int,is_stop:boolean,is_punct:boolean,like_num:boolean>>, noun_chunks array<struct<start:int,end:int>>"
    asked = spark.createDataFrame([(1, "Models share the weights", tokens, [(0, 1), (2, 4)]), (2, "", [], [])], schema)
    got = {r["qid"]: r["keywords"] for r in index.semantic_keywords(asked, letters26).collect()}
    assert set(got[1]) == {"share weight", "model share"} and got[2] == []


def test_find_and_download(spark, tmp_path):
    def search(query, most):
        title = query[4:-1]
        if title == "nothing":
            return "<feed></feed>"
        said = {"Deep words": "Deep  words", "Two: of a name": "Two of a name", "far": "Something else altogether"}[title]
        link = "" if title.startswith("Two") else f"<link title='pdf' href='http://x/{title[0]}'/>"
        return f"<feed><entry><id>id/{title[0]}</id><title>{said}</title>{link}</entry><entry><id>o</id><title>zz</title></entry></feed>"

    def put(target, blocks):
        with open(target, "wb") as f:
            f.writelines(blocks)

    titles = spark.createDataFrame([("Deep words",), ("Deep words",), ("Two: of a name",), ("far",), ("nothing",), (None,)], "query_title string")
    got = {r["query_title"]: r for r in files.find_and_download(titles, str(tmp_path), search, lambda url: iter([b"a", url.encode()]), put).collect()}
    assert set(got) == {"Deep words", "Two: of a name", "far"}
    assert got["Deep words"]["target"] == f"{tmp_path}/Deep words.pdf" and got["Deep words"]["accepted"]
    assert got["Two: of a name"]["accepted"] and got["Two: of a name"]["target"] is None
    assert not got["far"]["accepted"] and got["far"]["target"] is None
    assert [(p.name, p.read_bytes()) for p in tmp_path.glob("*.pdf")] == [("Deep words.pdf", b"ahttp://x/D")]


def test_papers_of_one_name(spark):
    rows = [("a", 0, "1", "A name", "u1"), ("A name", 0, "2", "A name", "u2"), ("a name", 0, "1", "A name", "u1")]
    got = {r["query_title"]: r["target"] for r in files.chosen_papers(spark.createDataFrame(rows, "query_title string, ord int, entry_id string, entry_title string, pdf_url string"), "out/").collect()}
    assert got == {"a": None, "A name": "out/A name_2.pdf", "a name": "out/A name_1.pdf"}


def test_embedding_cache(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0]), ("a", [1.0]), ("b", [2.0])], "text string, emb array<double>")
    files.write_embeddings(df, str(tmp_path / "cache"))
    assert sorted(map(tuple, files.read_embeddings(spark, str(tmp_path / "cache")).collect())) == [("a", [1.0]), ("b", [2.0])]


def test_places_of_many_rows_with_columns(spark):
    """Both sides have columns beside the order key, ties and more rows than one range."""
    n = 200_000
    left = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("a"), F.rand(1).alias("b"))
    right = spark.range(n + 5).select((F.col("id") * 104729 % (n + 5)).alias("j"), F.md5(F.col("id").cast("string")).alias("c"), F.rand(2).alias("d"))
    got = tables.join_by_position(left, right, "k", "j").agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.sum((F.col("k") != F.col("j")).cast("int"))).head()
    assert tuple(got) == (n, n, 0, n - 1, 0)
    tied = spark.range(1000).select(F.lit(1).alias("k"), "id")
    assert [r["pos"] for r in tables.join_by_position(tied, tied.select(F.col("k").alias("j"), F.col("id").alias("i2")), "k", "j").orderBy("pos").collect()] == list(range(1000))


@pytest.mark.parametrize("name", ["semantic_keywords", "surface_keywords"])
def test_every_question_has_a_row(spark, sf, name):
    got = QUERIES[name](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/benchmark.parquet").count() and any(r["keywords"] for r in got)
