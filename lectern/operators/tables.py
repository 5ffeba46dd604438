"""Merges and small relational steps on slide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean
from .shared import stored

DROPPED = ("desc_text", "title_text", "body_text", "ocr_text", "desc_chunks")


def join_by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides by their place, numbered from 0; the shorter side ends the result. Rows of equal order go by a
    hash of all their columns, maps included, and nulls come first. Columns of the right side that are named as one of the left get
    the prefix right_."""
    numbered = _numbered(right, right_order, "pos").withColumnsRenamed({c: f"right_{c}" for c in right.columns if c in left.columns})
    return _numbered(left, left_order, "pos").join(numbered, "pos")


def _numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Places without one global window: rows are ranged and numbered within their range once, and that table is stored;
    the counts of its ranges shift the numbers."""
    keys = [F.col(order), F.col("__tie")]
    ranged = df.withColumn("__tie", F.xxhash64(F.to_json(F.struct(*df.columns)))).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    # the low part of this id is the row's number within its partition
    table = stored(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = table.groupBy("__part").agg(F.count("*").alias("__c"))
    # one row a range
    starts = counts.select("__part", F.coalesce(F.sum("__c").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    return table.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__s") + F.col("__n")).cast("long")).drop("__part", "__n", "__s")


def merge_descriptions(slides: DataFrame, described: DataFrame) -> DataFrame:
    """slides with qa_descs of the same key, an empty map where there is none, without the working columns."""
    joined = slides.join(described.select("slide_key", "qa_descs"), "slide_key", "left")
    return joined.withColumn("qa_descs", F.coalesce("qa_descs", F.create_map().cast("map<string,string>"))).drop(*DROPPED)


def first_pages(df: DataFrame, page: str, n: int = 5) -> DataFrame:
    return df.where(F.col(page) < n)


def distinct_texts(df: DataFrame, text: str, order: str, value: str) -> DataFrame:
    """One row a text: at its first place, with its last value."""
    return df.groupBy(text).agg(F.min(order).alias("first_pos"), F.max_by(value, order).alias(value))


def best_title_match(entries: DataFrame, least: float = 0.75) -> DataFrame:
    """The likeliest entry of each query title; accepted marks scores of at least ``least``, no row is dropped."""
    from ..plans.models import title_ratio

    scored = entries.withColumn("score", title_ratio(clean(F.col("query_title"), "title_key"), clean(F.col("entry_title"), "title_key")))
    best = scored.groupBy("query_title").agg(F.max_by(F.struct("entry_id", "entry_title", "score"), F.struct(F.col("score"), -F.col("ord"))).alias("b"))
    return best.select("query_title", "b.entry_id", "b.entry_title", "b.score", (F.col("b.score") >= least).alias("accepted"))
