"""Readers and writers: JSON tables, questions, page files, images, answers, web entries."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators.shared import stored
from ..operators.tables import best_title_match

BLOCKS = "array<struct<type:int,lines:array<struct<spans:array<struct<text:string,origin:array<double>>>>>,image:binary>>"
ATOM = "array<struct<id:string,title:string,link:array<struct<_title:string,_href:string>>>>"


def read_slides(spark: SparkSession, path: str, value: str) -> DataFrame:
    """slide_key and value of one JSON object keyed by slide; ``value`` is the DDL type of an entry."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("slide_key", "slide"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """qnum and question of a JSON list, in its order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<struct<question:string>>")).alias("qnum", "q")).select("qnum", "q.question")


def write_slides(df: DataFrame, path: str) -> None:
    """One JSON object a line: the form that scales; ``as_object`` makes the single object of small tables."""
    df.write.mode("overwrite").json(path)


def as_object(df: DataFrame, key: str, limit: int = 100_000) -> str:
    """The table as one JSON object keyed by ``key``, for at most ``limit`` rows."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows: use write_slides")
    packed = df.select(F.struct(F.col(key).cast("string").alias("k"), F.struct(*[c for c in df.columns if c != key]).alias("v")).alias("e"))
    return packed.agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("j")).head()["j"]


def write_answers(df: DataFrame, path: str, with_confidence: bool = True) -> None:
    """Question, slide number, (confidence,) content as CSV with a header; quotes are doubled."""
    names = [("question", "Question"), ("slide_number", "Slide number"), *([("confidence", "Confidence")] if with_confidence else []), ("content", "Content")]
    df.select(*[F.col(a).alias(b) for a, b in names]).write.mode("overwrite").csv(path, header=True, escape='"', quote='"')


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]], pages: int | None = None) -> DataFrame:
    """path, page_no, blocks of page files; ``parse`` turns the bytes of a file into its pages' blocks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"], strict=True):
                for i, blocks in enumerate(parse(content)[:pages]):
                    yield pd.DataFrame({"path": [p], "page_no": [i], "blocks": [blocks]})

    return read_images(spark, path).mapInPandas(run, f"path string, page_no int, blocks {BLOCKS}")


def pdf_parser() -> Callable[[bytes], list[dict]]:
    def parse(content: bytes) -> list[dict]:
        from ..plans.models import need

        doc = need("pymupdf").open(stream=content)
        origin = lambda s: list(map(float, s["origin"])) if s.get("origin") else None
        return [[{"type": b["type"], "lines": [{"spans": [{"text": s.get("text", ""), "origin": origin(s)} for s in ln["spans"]]} for ln in b.get("lines", [])], "image": b.get("image")} for b in page.get_text(option="dict")["blocks"]] for page in doc]

    return parse


def plain_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page_no, text of PDF files in reading order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..plans.models import need

        for part in parts:
            for p, content in zip(part["path"], part["content"], strict=True):
                for i, page in enumerate(need("pymupdf").open(stream=content)):
                    yield pd.DataFrame({"path": [p], "page_no": [i], "text": [page.get_text(sort=True)]})

    return read_images(spark, path).mapInPandas(run, "path string, page_no int, text string")


def atom_entries(feeds: DataFrame) -> DataFrame:
    """query_title, ord, entry_id, entry_title, pdf_url from (query_title, xml) of Atom feeds, or from their pages (query_title, start, xml)."""
    entry = F.from_xml("xml", F.lit("entry " + ATOM), {"rowTag": "feed"})
    start = F.col("start") if "start" in feeds.columns else F.lit(0)
    e = feeds.select("query_title", start.alias("start"), F.posexplode(entry["entry"]).alias("at", "e")).withColumn("ord", F.col("start") + F.col("at"))
    pdf = F.get(F.filter("e.link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    return e.select("query_title", "ord", F.col("e.id").alias("entry_id"), F.trim(F.regexp_replace("e.title", r"\s+", " ")).alias("entry_title"), pdf.alias("pdf_url"))


def title_query(title: str) -> str:
    """The query of a title; what would end its quotes early is a blank."""
    return 'ti:"' + " ".join(re.sub(r'["\\]', " ", title).split()) + '"'


def search_feeds(titles: DataFrame, fetch: Callable[[str, int], str], most: int = 5) -> DataFrame:
    """query_title, xml of every distinct title: ``fetch`` asks a service for the feed of a title query of ``most`` entries."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"query_title": part["query_title"], "xml": [fetch(title_query(t), most) for t in part["query_title"]]})

    return titles.where("query_title IS NOT NULL").select("query_title").distinct().mapInPandas(run, "query_title string, xml string")


PAGES = "query_title string, start int, xml string, error string"


def stored_pages(spark: SparkSession, store: str) -> DataFrame:
    """query_title, start, xml of the pages that ``store`` holds; none, if it isn't there yet."""
    try:
        pages = spark.read.schema(PAGES).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        pages = spark.createDataFrame([], PAGES)
    return pages.where("xml IS NOT NULL").groupBy("query_title", "start").agg(F.any_value("xml").alias("xml"))


def search_pages(titles: DataFrame, fetch: Callable[[str, int, int], str], store: str, most: int = 5, page: int = 5, retries: int = 3, wait: float = 1.0, per_second: float | None = None, tasks: int = 8) -> DataFrame:
    """query_title, start, xml: the pages of the first ``most`` entries of every distinct title, asked for ``page`` at a time.

    ``fetch(query, start, count)`` asks the service; a request that fails is repeated ``retries`` times, with doubled waits, and then noted with its error.
    All tasks together ask at most ``per_second`` times a second. Pages are appended to the table ``store``: what it holds
    is never asked for again, so a call that broke off or met errors is simply repeated and asks for the rest.
    """
    spark = titles.sparkSession

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap, last = (tasks / per_second if per_second else 0.0), 0.0
        for part in parts:
            for title, start, count in part.itertuples(index=False):
                xml = error = None
                for attempt in range(retries + 1):
                    time.sleep(max(0.0, last + gap - time.monotonic(), wait * 2 ** (attempt - 1) if attempt else 0.0))
                    last = time.monotonic()
                    try:
                        xml, error = fetch(title_query(title), int(start), int(count)), None
                        break
                    except Exception as e:  # whatever a service or its library raises
                        error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"query_title": [title], "start": [start], "xml": [xml], "error": [error]})

    wanted = titles.where("query_title IS NOT NULL").select("query_title").distinct().select("query_title", F.explode(F.sequence(F.lit(0), F.lit(most - 1), F.lit(page))).alias("start"))
    left = wanted.join(stored_pages(spark, store).select("query_title", "start"), ["query_title", "start"], "left_anti")
    asked = left.select("query_title", "start", F.least(F.lit(page), most - F.col("start")).alias("count")).repartition(tasks, "query_title", "start")
    asked.mapInPandas(run, PAGES).write.mode("append").parquet(store)
    return stored_pages(spark, store).join(wanted, ["query_title", "start"], "left_semi")


def chosen_papers(entries: DataFrame, folder: str, least: float = 0.75) -> DataFrame:
    """The likeliest entry of each title and the path it is stored under; null where it is too unlike or has no file.

    Equal names of different papers are told apart by the entry.
    """
    best = best_title_match(entries, least).join(entries.select("query_title", "entry_id", F.col("pdf_url").alias("url")).distinct(), ["query_title", "entry_id"])
    name = clean(F.col("entry_title"), "safe_filename")
    shared = best.where("accepted AND url IS NOT NULL").groupBy(name.alias("name")).agg(F.count_distinct("entry_id").alias("n")).where("n > 1")
    named = best.withColumn("name", name).join(shared, "name", "left")
    own = F.when(F.col("n").isNull(), F.col("name")).otherwise(F.concat_ws("_", "name", clean(F.col("entry_id"), "safe_filename")))
    target = F.when(F.col("accepted") & F.col("url").isNotNull(), F.concat(F.lit(folder.rstrip("/") + "/"), own, F.lit(".pdf")))
    return named.select("query_title", "entry_id", "entry_title", "score", "accepted", "url", target.alias("target"))


def find_and_download(titles: DataFrame, folder: str, search: Callable[[str, int], str], fetch: Callable[[str], Iterator[bytes]], put: Callable[[str, Iterator[bytes]], None], least: float = 0.75) -> DataFrame:
    """Searches every title, stores the files of accepted entries once each, and returns the table of choices.

    The choices are stored before anything is fetched, so a lost executor repeats no search with another answer.
    """
    chosen = stored(chosen_papers(atom_entries(search_feeds(titles, search)), folder, least))
    download(chosen.where("target IS NOT NULL").select("url", "target").dropDuplicates(["target"]), fetch, put)
    return chosen


def write_embeddings(df: DataFrame, path: str) -> None:
    """The cache of vectors: one row a distinct text (text, emb)."""
    df.select("text", "emb").dropDuplicates(["text"]).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("text", "emb")


def download(urls: DataFrame, fetch: Callable[[str], Iterator[bytes]], put: Callable[[str, Iterator[bytes]], None]) -> None:
    """Side effect a row (url, target): ``fetch`` yields blocks, ``put`` stores them where executors can."""
    urls.select("url", "target").foreachPartition(lambda rows: [put(r["target"], fetch(r["url"])) for r in rows] and None)


def write_annotated(answers: DataFrame, write: Callable[[str, int, str], None]) -> None:
    """Hands (path, page, question) of the winning pages to a PDF writer, in the partitions."""
    answers.select("path", "page", "question").foreachPartition(lambda rows: [write(r["path"], r["page"], r["question"]) for r in rows] and None)


def page_images(spark: SparkSession, path: str, render: Callable[[bytes], list[bytes]]) -> DataFrame:
    """path, name (0001.jpg ...), image of every page that ``render`` draws."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"], strict=True):
                for i, image in enumerate(render(content)):
                    yield pd.DataFrame({"path": [p], "name": [f"{i + 1:04}.jpg"], "image": [image]})

    return read_images(spark, path).mapInPandas(run, "path string, name string, image binary")
