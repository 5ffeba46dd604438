"""A read-through cache of vectors: a table (key, text, place, emb) in generations, keyed by a hash of the text.

Only texts without a vector are encoded, each once however often it occurs. A generation is a partition that its writer replaces as a
whole: a task that is retried adds nothing, and a writer that starts again with the same generation, having read the ones before, ends
with the same table. Texts meet by their key; neither vectors nor texts of the cache travel for the search of misses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, text string, place string, emb array<double>, generation long"


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def generations(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The cache's rows as they were written, up to the generation ``before``; a cache that isn't there yet has none."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return rows if before is None else rows.where(F.col("generation") < before)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """key, text, place, emb: one row a text, at the first place it was seen, with the vector written last."""
    rows = generations(spark, path)
    last = rows.groupBy("key").agg(F.min_by(F.struct("text", "place"), "generation").alias("first"), F.max_by("emb", "generation").alias("emb"))
    return last.select("key", "first.text", "first.place", "emb")


def next_generation(spark: SparkSession, path: str) -> int:
    return generations(spark, path).agg(F.coalesce(F.max("generation") + 1, F.lit(0)).alias("g")).head()["g"]


def missing(texts: DataFrame, cached: DataFrame) -> DataFrame:
    """key, text, place of the distinct texts (text, place) that ``cached`` has no vector of; their smallest place. Null texts have no vector."""
    keyed = texts.where("text IS NOT NULL").select(text_key(F.col("text")).alias("key"), "text", F.col("place").cast("string").alias("place"))
    new = keyed.join(cached.select("key").distinct(), "key", "left_anti")
    return new.groupBy("key").agg(F.any_value("text").alias("text"), F.min("place").alias("place"))


def fill(texts: DataFrame, path: str, encode: Callable[[Column], Column], generation: int | None = None) -> None:
    """Adds vectors of the texts (text, place) that the cache lacks, as one generation: the next one, unless it is named."""
    spark = texts.sparkSession
    number = next_generation(spark, path) if generation is None else generation
    new = missing(texts, generations(spark, path, number)).withColumn("emb", encode(F.col("text")).cast("array<double>"))
    made = new.select("key", "text", "place", "emb", F.lit(number).cast("long").alias("generation"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(path)


def read_through(texts: DataFrame, path: str, encode: Callable[[Column], Column]) -> DataFrame:
    """``texts`` (text, place, ...) with emb, from the cache, which has all of them by then. Null texts have a null vector."""
    fill(texts.select("text", "place"), path, encode)
    known = read_vectors(texts.sparkSession, path).select("key", "emb")
    return texts.withColumn("__key", text_key(F.col("text"))).join(known, F.col("__key") == F.col("key"), "left").drop("__key", "key")
