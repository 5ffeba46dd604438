"""Incremental embedding of papers: takes the files of documents that came since the last run, cuts their texts into short
chunks and adds the vectors of chunks that no earlier run has seen.

A file stream with a checkpoint knows which files are done. Each of its batches is a generation of the vector cache, partitioned by
it; a batch that is repeated after a failure replaces its own generation, so every distinct chunk is encoded and written once.
"""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, encoder, log
from lectern.functions import splitting as P
from lectern.functions import text as T
from lectern.operators import cache


def chunks_of(documents: DataFrame, max_chars: int, min_chars: int) -> DataFrame:
    """text, place (document, chunk) of the chunks of every whole text; null and blank texts have none. Places compare as they are counted."""
    packed = P.pack_chars(P.paper_sentences(T.clean(F.coalesce("text", F.lit("")), "clean_pdf")), max_chars, min_chars)
    each = documents.select("doc_id", F.posexplode(packed).alias("at", "text"))
    return each.where("text <> ''").select("text", F.format_string("%020d.%08d", F.col("doc_id").cast("long"), F.col("at")).alias("place"))


def embed_chunks(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict) -> dict:
    """Add the vectors of new chunks of the documents (doc_id, text) to the table ``output``; ends when all files are taken."""
    encode = encoder(config["encoder"])
    given = spark.readStream.schema(spark.read.parquet(documents).select("doc_id", "text").schema)
    if config["files_per_batch"]:
        given = given.option("maxFilesPerTrigger", config["files_per_batch"])
    # a table may be a single file, which a stream takes as a pattern only
    stream = given.parquet(documents if _is_folder(spark, documents) else f"{documents[:-1]}[{documents[-1]}]")
    taken = {"batches": 0, "documents": 0, "chunks": 0}

    def each(batch: DataFrame, number: int) -> None:
        cores = spark.sparkContext.defaultParallelism
        docs = batch.repartition(cores) if batch.rdd.getNumPartitions() < cores else batch
        cache.fill(chunks_of(docs, config["max_chars"], config["min_chars"]), output, encode, number)
        new = cache.generations(spark, output).where(F.col("generation") == number).count()
        read = batch.count()
        taken.update(batches=taken["batches"] + 1, documents=taken["documents"] + read, chunks=taken["chunks"] + new)
        log.info("batch %d: read %d documents from %s, wrote %d new chunks to %s", number, read, documents, new, output)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d batches, %d documents, %d new chunks; %s holds %d", *taken.values(), output, cache.generations(spark, output).count())
    return taken


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is a folder of files: only a folder can be the base of a partitioned table."""
    try:
        spark.read.option("basePath", path).parquet(path)
    except IllegalArgumentException:
        return False
    return True


if __name__ == "__main__":
    command("embed_chunks", {"documents": "table of doc_id, text; files are added to it", "output": "table of vectors", "checkpoint": "folder of the stream's progress"}, embed_chunks)
