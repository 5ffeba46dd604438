"""Ordered and greedy operators against short loops; records; sources; streaming."""

import json
import random

from pyspark.sql import functions as F

from lectern.operators import layout, phrases, ranking, records, tables
from lectern.plans import models
from lectern.sources import files
from lectern.streaming.questions import answer_stream


def test_rows_by_running_mean(spark):
    rng = random.Random(1)
    groups = [(g, [(f"t{i}", rng.randint(0, 9), float(rng.randint(0, 60)), i) for i in range(rng.randint(1, 15))]) for g in range(40)]
    df = spark.createDataFrame(groups, "g int, i array<struct<text:string,x1:int,cy:double,seq:int>>")
    for g, got in df.select("g", layout.rows_to_lines(layout.rows(F.col("i"), 18.0))).collect():
        rows, cur = [], []
        for t in sorted(groups[g][1], key=lambda t: (t[2], t[1])):
            if cur and abs(t[2] - sum(x[2] for x in cur) / len(cur)) > 18:
                rows.append(cur)
                cur = []
            cur.append(t)
        rows.append(cur)
        assert got == [" ".join(t[0] for t in sorted(r, key=lambda t: t[1])) for r in rows]


def test_duplicate_boxes_meet_kept_ones_only(spark):
    box = lambda t, x: (t, x, 0, x + 10, 10)
    df = spark.createDataFrame([([box("a", 0), box("A ", 3), box("a", 6), box("b", 0)],)], "i array<struct<text:string,x1:int,y1:int,x2:int,y2:int>>")
    assert [x["x1"] for x in df.select(layout.distinct_boxes(F.col("i"))).head()[0]] == [0, 6, 0]


def test_mmr_against_loop(spark):
    rng = random.Random(2)
    for _ in range(5):
        names = [f"w{i}" if i % 2 else f"two w{i}" for i in range(8)]
        e = [[rng.uniform(-1, 1) for _ in range(4)] for _ in names]
        q = [rng.uniform(-1, 1) for _ in range(4)]
        dot = lambda a, b: sum(x * y for x, y in zip(a, b))
        chosen = []
        while len(chosen) < 5:
            best = max((i for i in range(8) if i not in chosen), key=lambda i: (0.8 * dot(e[i], q) - 0.2 * max([dot(e[i], e[j]) for j in chosen], default=0.0) + 0.03 * (" " in names[i]), -i))
            chosen.append(best)
        df = spark.createDataFrame([(names, e, q)], "n array<string>, e array<array<double>>, q array<double>")
        assert df.select(phrases.mmr(F.col("n"), F.col("e"), F.col("q"), 5)).head()[0] == chosen


def test_phrase_sources(spark):
    tok = lambda i, t, lemma, pos, dep, head, stop=False: (i, t, lemma, pos, dep, head, stop, False, False)
    tokens = [tok(0, "Models", "model", "NOUN", "nsubj", 1), tok(1, "share", "share", "VERB", "ROOT", 1), tok(2, "the", "the", "DET", "det", 3, True), tok(3, "weights", "weight", "NOUN", "dobj", 1)]
    schema = "t array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head:int,is_stop:boolean,is_punct:boolean,like_num:boolean>>, c array<struct<start:int,end:int>>"
    df = spark.createDataFrame([(tokens, [(0, 1), (2, 4)])], schema)
    assert df.select(phrases.semantic_sources(F.col("t"), F.col("c"))).head()[0] == ["model", "weight", "share", "share weight", "model share"]
    assert df.select(phrases.surface_sources(F.col("t"), F.col("c"))).head()[0] == ["models", "share weights"]


def test_references(spark):
    def of(t):
        r = spark.range(1).select(records.reference_from_parts(records.source_reference(F.lit(t))).alias("r")).head()["r"]
        return r and (r["title"], r["venue"], r["year"])

    assert of("x Source: Title, A. B, VENUE. 2017 y") == ("Title, A, B", "VENUE", 2017)
    assert of("Source: Title, VENUE 2017") is None
    assert of("no source") is None
    chunks = spark.range(1).select(records.reference_chunks(F.lit(3), records.reference_from_parts(records.source_reference(F.lit("Source: A title, ACL, 2019"))))).head()[0]
    assert [(c["field"], c["order"], c["chunk_id"]) for c in chunks] == [("reference_title", 400, "3_reference_title_0"), ("reference_venue", 401, "3_reference_venue_1"), ("reference_raw", 402, "3_reference_raw_2")]


def test_slides_without_descriptions_stay(spark):
    described = spark.createDataFrame([(1, "a", "text", [1.0, 0.0]), (2, "a", " N/A ", [1.0, 0.0])], "slide_id int, qtype string, text string, emb array<double>")
    ranked = ranking.rank_by_descriptions(spark.createDataFrame([(1,), (2,)], "slide_id int"), described, spark.createDataFrame([(0, "a", 0.5)], "qid int, qtype string, weight double"), spark.createDataFrame([(0, [-1.0, 0.0])], "qid int, q_emb array<double>"))
    assert [(r["slide_id"], r["score"]) for r in ranked.orderBy("rank").collect()] == [(2, 0.0), (1, -1.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"0": {"title": "a"}, "1": {"title": "b"}}))
    (tmp_path / "q.json").write_text(json.dumps([{"question": "x"}, {"question": "y"}]))
    assert {r["slide_key"]: r["slide"]["title"] for r in files.read_slides(spark, str(tmp_path / "s.json"), "struct<title:string>").collect()} == {"0": "a", "1": "b"}
    questions = files.read_questions(spark, str(tmp_path / "q.json"))
    assert [tuple(r) for r in questions.orderBy("qnum").collect()] == [(0, "x"), (1, "y")]
    assert json.loads(files.as_object(questions, "qnum")) == {"0": {"question": "x"}, "1": {"question": "y"}}
    answers = spark.createDataFrame([('say "x"', 1, 0.5, "a\nb")], "question string, slide_number int, confidence double, content string")
    files.write_answers(answers, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"', multiLine=True).head()
    assert (back["Question"], back["Slide number"], back["Content"]) == ('say "x"', "1", "a\nb")
    feed = "<feed><entry><id>1</id><title>A  b</title><link title='pdf' href='u'/><link href='v'/></entry><entry><id>2</id><title>C</title><link href='w'/></entry></feed>"
    entries = files.atom_entries(spark.createDataFrame([("q", feed)], "query_title string, xml string"))
    assert [tuple(r) for r in entries.orderBy("ord").collect()] == [("q", 0, "1", "A b", "u"), ("q", 1, "2", "C", None)]


def test_stream(spark, tmp_path, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    v.where("vec_id < 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_emb")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, q_emb array<float>").parquet(str(tmp_path / "in"))
    pages = v.where("vec_id >= 3").select(F.col("vec_id").alias("page"), F.col("embedding").alias("emb"))
    run = answer_stream(stream, pages, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_paged_search_of_a_flaky_service(spark, tmp_path):
    """Failing requests are repeated, then noted; stored pages are never asked for again; entries are numbered through their pages."""
    asked = spark.sparkContext.accumulator(0)
    log = str(tmp_path / "asked")

    def fetch(query, start, count):
        asked.add(1)
        with open(log, "a") as f:
            f.write(f"{query} {start}\n")
        tries = open(log).read().split("\n").count(f"{query} {start}")
        if "down" in query and tries <= 4 or "flaky" in query and tries == 1:
            raise OSError("no answer")
        entries = "".join(f"<entry><id>{query[4:-1]}-{i}</id><title>T {i}</title><link href='x'/></entry>" for i in range(start, min(start + count, 7)))
        return f"<feed>{entries}</feed>"

    titles = spark.createDataFrame([("flaky",), ("fine",), ('with "quotes" \\',), ("down",), ("fine",), (None,)], "query_title string")
    call = lambda: files.search_pages(titles, fetch, str(tmp_path / "store"), most=8, page=3, retries=2, wait=0.01, per_second=400.0, tasks=2)
    first = call()
    assert first.count() == 9  # three pages each of the titles whose service answered
    assert asked.value == 3 * 2 + 3 + 3 + 3 * 3
    assert open(log).read().count('ti:"with quotes"') == 3
    assert call().count() == 12 and asked.value == 21 + 3 * 2  # of those that failed alone
    assert call().count() == 12 and asked.value == 27
    entries = files.atom_entries(call()).where("query_title = 'fine'").orderBy("ord").collect()
    assert [(r["ord"], r["entry_id"]) for r in entries] == [(i, f"fine-{i}") for i in range(7)]


def test_positional_join_of_maps_and_equal_names(spark):
    left = spark.createDataFrame([(2, {"a": "x"}, "l2"), (1, {"b": "y"}, "l1"), (None, None, "l0")], "k int, m map<string,string>, v string")
    right = spark.createDataFrame([(5, "r0"), (7, "r1")], "k int, v string")
    got = tables.join_by_position(left, right, "k", "k").orderBy("pos").collect()
    assert [(r["pos"], r["k"], r["m"], r["v"], r["right_k"], r["right_v"]) for r in got] == [(0, None, None, "l0", 5, "r0"), (1, 1, {"b": "y"}, "l1", 7, "r1")]


def test_reports_cut_texts_and_fields(spark):
    ranked = spark.createDataFrame([(1, i, "x" * (240 + 5 * i)) for i in range(1, 9)], "qid int, rank int, best_text string")
    assert [(r["rank"], len(r["shown"])) for r in ranking.report(ranked).orderBy("rank").collect()] == [(1, 245), (2, 250), (3, 250), (4, 250), (5, 250)]
    fields = spark.createDataFrame([(1, i, list(range(i))) for i in range(1, 13)], "qid int, rank int, matched array<int>")
    assert [r["matched"] for r in ranking.field_report(fields).orderBy("rank").collect()] == [list(range(min(i, 3))) for i in range(1, 11)]


def test_older_readers_of_blocks_and_references(spark):
    line = lambda t, o: {"spans": [{"text": t, "origin": o}]}
    page = [(0, [line("below", [1.0, 9.0])], None), (0, [line(" top ", [5.0, 2.0]), line("more", None)], None), (1, [], b"png"), (0, [line("nowhere", None)], None), (0, [line("  ", [0.0, 0.0])], None)]
    df = spark.createDataFrame([(page,)], f"b {files.BLOCKS}")
    assert df.select(layout.text_of_blocks(F.col("b"))).head()[0] == "top  more\nbelow\n"
    assert [x["image"] for x in df.select(layout.images(F.col("b"))).head()[0]] == [b"png"]
    comma = lambda t: spark.range(1).select(records.split_reference(F.lit(t), ",").alias("r")).head()["r"]
    assert tuple(comma("On words, vol. 2, ACL, 2019")) == ("On words, vol. 2", "ACL", 2019)
    assert comma("On words. ACL. 2019") is None


def test_model_boundaries_with_fakes(spark):
    tok = lambda lemma, stop=False, punct=False: (0, lemma, lemma, "NOUN", "dep", 0, stop, punct, False)
    parsed = spark.createDataFrame([([tok("the", True), tok("graph"), tok(".", False, True), tok("word")],)], f"t {models.TOKENS}")
    assert tuple(parsed.select(models.lemmas(F.col("t")), models.lemmas(F.col("t"), True)).head()) == ("the graph . word", "graph word")
    sizes = []
    coded = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(70)], "i int, t string").coalesce(1).select("i", models.encoder(lambda texts: sizes.append(len(texts)) or [[float(len(t)), 1.0] for t in texts])(F.col("t")).alias("e"))
    assert {r["i"]: r["e"] for r in coded.collect()} == {i: [float(0 if i == 3 else i), 1.0] for i in range(70)}
    seen = spark.createDataFrame([(b"ab",), (b"",)], "image binary")
    found = seen.select(models.recognizer(lambda b: [(chr(c), (i, 0, i + 2, 4)) for i, c in enumerate(b)])(F.col("image")).alias("o")).collect()
    assert [[(t["text"], t["bbox"], t["cx"], t["cy"], t["seq"]) for t in r["o"]] for r in found] == [[("a", [0, 0, 2, 4], 1.0, 2.0, 0), ("b", [1, 0, 3, 4], 2.0, 2.0, 1)], []]
    assert [r[0] for r in seen.select(models.captioner(lambda b, p: f"{p}: {len(b)} bytes")(F.col("image"), F.lit("size"))).collect()] == ["size: 2 bytes", "size: 0 bytes"]
    try:
        models.need("no_such_library_here")
        raise AssertionError
    except models.MissingLibrary as e:
        assert "no_such_library_here" in str(e)
