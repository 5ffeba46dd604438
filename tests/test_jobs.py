"""The jobs: same rows on a rerun, growing input, command lines, and the vector cache below them."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs.answer_questions import answer_questions, read_answers
from jobs.common import settings
from jobs.embed_chunks import chunks_of, embed_chunks
from jobs.registered import ORACLES, QUERIES
from lectern.operators import cache
from lectern.plans.models import encoder

ROOT = Path(__file__).resolve().parents[1]


def flat(rows):
    return sorted(tuple(round(v, 5) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    assert flat(df.collect()) == flat(duck.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall())


@pytest.fixture
def growing(spark, sf, tmp_path):
    """A table of documents that comes in two parts, the second with texts of the first."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    first, second = docs.iloc[:90], docs.iloc[80:160]
    second = second.assign(doc_id=second["doc_id"] + 1000)
    (tmp_path / "documents").mkdir()
    first.to_parquet(tmp_path / "documents" / "a.parquet")

    def grow():
        second.to_parquet(tmp_path / "documents" / "b.parquet")

    return tmp_path, grow


def test_embed_chunks_takes_only_what_is_new(spark, growing):
    base, grow = growing
    config = settings("embed_chunks")
    run = lambda: embed_chunks(spark, f"file://{base}/documents", f"file://{base}/out", f"file://{base}/progress", config)
    table = lambda: flat(cache.generations(spark, f"file://{base}/out").drop("emb").collect())
    first = run()
    before = table()
    assert first["documents"] == 90 and first["chunks"] == len(before)
    assert run() == {"batches": 0, "documents": 0, "chunks": 0} and table() == before
    seen = chunks_of(spark.read.parquet(f"{base}/documents"), config["max_chars"], config["min_chars"]).collect()
    grow()
    every = chunks_of(spark.read.parquet(f"{base}/documents"), config["max_chars"], config["min_chars"]).collect()
    second = run()
    after = table()
    assert second["documents"] == 80 and set(before) < set(after)
    assert {t for t in after if t not in before} == {t for t in after if t[3] == "1" or t[-1] == "1"}
    places = {}
    for r in sorted(seen, key=lambda r: r["place"]) + sorted(every, key=lambda r: r["place"]):
        places.setdefault(r["text"], r["place"])
    got = {r["text"]: r["place"] for r in cache.read_vectors(spark, f"file://{base}/out").collect()}
    assert got == places and len(after) == len(places)
    assert run()["batches"] == 0 and table() == after
    assert sorted(p.name for p in (base / "out").iterdir() if p.is_dir()) == ["generation=0", "generation=1"]


def test_embed_chunks_repeats_a_lost_batch(spark, growing):
    """A batch whose end wasn't noted runs again and replaces what it had written."""
    base, grow = growing
    run = lambda: embed_chunks(spark, f"{base}/documents", f"{base}/out", f"{base}/progress", settings("embed_chunks"))
    run()
    grow()
    run()
    table = flat(cache.generations(spark, f"{base}/out").drop("emb").collect())
    for f in (base / "progress" / "commits").glob("*1*"):
        f.unlink()
    assert run()["batches"] == 1
    assert flat(cache.generations(spark, f"{base}/out").drop("emb").collect()) == table


def test_embed_chunks_of_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (None, "A word. Another one."), (4, "A word. Another one."), (5, "long " * 50000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    embed_chunks(spark, f"{tmp_path}/documents", f"{tmp_path}/out", f"{tmp_path}/progress", settings("embed_chunks"))
    got = cache.read_vectors(spark, f"{tmp_path}/out").collect()
    assert len(got) == 2 and all(len(r["emb"]) == 26 for r in got)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none")
    assert embed_chunks(spark, f"{tmp_path}/none", f"{tmp_path}/out2", f"{tmp_path}/progress2", settings("embed_chunks"))["chunks"] == 0


def test_answers_again_and_replaced(spark, sf, tmp_path):
    docs = spark.createDataFrame([(0, "Cats\nCats purr when they rest. Dogs bark loudly at night.", "en"), (1, None, None), (2, "Trees", "de"), (None, "gone", "en")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "How many cats purr?"), (2, None), (3, "")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents")
    asked.write.parquet(f"{tmp_path}/questions")
    run = lambda: answer_questions(spark, f"{tmp_path}/documents", f"{tmp_path}/questions", f"{tmp_path}/out", settings("answer_questions"))
    counts = run()
    assert counts == {"pages": 3, "chunks": 2, "answers": 9}
    rows = flat(read_answers(spark, f"{tmp_path}/out").collect())
    best = [r for r in read_answers(spark, f"{tmp_path}/out").collect() if r["qid"] == 1 and r["rank"] == 1][0]
    assert best["slide_number"] == 1 and best["content"] == "Cats purr when they rest."
    assert run() == counts and flat(read_answers(spark, f"{tmp_path}/out").collect()) == rows
    docs.where("doc_id = 2").write.mode("overwrite").parquet(f"{tmp_path}/documents")
    assert run()["answers"] == 3  # nothing of the earlier pages is left
    assert {r["slide_number"] for r in read_answers(spark, f"{tmp_path}/out").collect()} == {3}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents")
    assert run()["answers"] == 0


def test_command_lines(sf, tmp_path):
    (tmp_path / "own.json").write_text('{"answers": 1}')
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    shutil.copy(f"{sf}/documents.parquet", tmp_path / "documents.parquet")
    call = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    said = call("jobs.answer_questions", "--documents", f"{tmp_path}/documents.parquet", "--questions", f"{sf}/benchmark.parquet", "--output", f"{tmp_path}/out", "--config", f"{tmp_path}/own.json")
    assert said.returncode == 0, said.stderr[-2000:]
    assert re.search(r"read \d+ documents", said.stderr) and re.search(r"wrote \d+ rows to .*answers", said.stderr)
    n = duckdb.sql(f"SELECT count(*), count(DISTINCT qid) FROM '{tmp_path}/out/answers/*/*.parquet'").fetchall()[0]
    assert n[0] == n[1] > 0
    said = call("jobs.embed_chunks", "--documents", f"{tmp_path}/documents.parquet", "--output", f"{tmp_path}/vectors", "--checkpoint", f"{tmp_path}/progress")
    assert said.returncode == 0, said.stderr[-2000:]
    assert "1 batches" in said.stderr
    (tmp_path / "own.json").write_text('{"answer": 1}')
    assert call("jobs.answer_questions", "--documents", "x", "--questions", "y", "--output", "z", "--config", f"{tmp_path}/own.json").returncode != 0


def test_cache_encodes_each_new_text_once(spark, tmp_path):
    counted = spark.sparkContext.accumulator(0)

    def encode(texts):
        counted.add(len(texts))
        return [[float(len(t))] for t in texts]

    path = f"{tmp_path}/cache"
    texts = lambda rows: spark.createDataFrame(rows, "text string, place string")
    got = cache.read_through(texts([("a", "3"), ("bb", "1"), ("a", "2"), (None, "4"), ("", "5")]), path, encoder(encode)).collect()
    assert counted.value == 3
    assert sorted((r["text"], r["place"], r["emb"]) for r in got if r["text"] is not None) == [("", "5", [0.0]), ("a", "2", [1.0]), ("a", "3", [1.0]), ("bb", "1", [2.0])]
    assert [r["emb"] for r in got if r["text"] is None] == [None]
    cache.read_through(texts([("a", "0"), ("ccc", "7")]), path, encoder(encode)).collect()
    assert counted.value == 4
    cache.fill(texts([("ccc", "7"), ("dddd", "8")]), path, encoder(encode), 1)  # the generation again: it replaces itself
    assert counted.value == 6
    # two writers that both missed a text: the last vector wins, the first place stays
    spark.createDataFrame([(cache.read_vectors(spark, path).where("text = 'a'").head()["key"], "a", "9", [7.0], 2)], cache.SCHEMA).write.mode("append").partitionBy("generation").parquet(path)
    assert {r["text"]: (r["place"], r["emb"]) for r in cache.read_vectors(spark, path).collect()} == {"": ("5", [0.0]), "a": ("2", [7.0]), "bb": ("1", [2.0]), "ccc": ("7", [3.0]), "dddd": ("8", [4.0])}
