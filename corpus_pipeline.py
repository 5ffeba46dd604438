"""From raw documents to token ids: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next one.
All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.bpe import encode_documents
from lectern.llm.common import settled, table
from lectern.llm.lines import drop_repeated_lines
from lectern.llm.minhash import drop_near_duplicates
from lectern.llm.mixing import mix_documents
from lectern.llm.quality import quality_filter
from lectern.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and blank texts fail them; null lang and source are groups of their own."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line makes redundant; a document that lost its last word goes."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the smallest doc_id of each group stays. Rows without doc_id or without words stay."""
    return drop_near_duplicates(docs, size=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each copy. Documents without words have no copy."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, digests of ids and decoded text, and the ids, of each row."""
    return encode_documents(docs, vocabulary(), keep=("doc_id", "source"), with_ids=True)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("mixing", mixing), ("BPE", tokens)]

#: SQL can't express signatures, rounding and merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's output replaces that of the stage before in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(partial(stage, spark, docs, sf_dir), spent=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
