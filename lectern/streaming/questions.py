"""A stream of questions against a static page index: dense retrieval per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.ranking import dense


def answer_stream(questions: DataFrame, pages: DataFrame, sink: str, k: int = 1) -> DataStreamWriter:
    """Append the ``k`` best pages of each arriving question (qid, q_emb) to the Parquet folder ``sink``.

    A batch that is repeated after a failure replaces its own folder, so answers are written once.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        dense(batch, pages, k).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return questions.writeStream.foreachBatch(each)
