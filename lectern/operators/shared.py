"""Tables that operators store on their way, and broadcasts behind a counted bound."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows is broadcast.
BROADCAST_ROWS = 10_000
#: Bytes of an Arrow batch on its way to a Python worker.
ARROW_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder that spark.checkpoint.dir names. Only a local session may go without it.

    What is read twice is then the same both times, whichever executor is lost meanwhile.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    path = f"{folder.rstrip('/')}/lectern-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for spark, path in _written:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone by now
            return


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` as it is. Where the session doesn't say how large Arrow batches are, they stay small from now on: executor and worker each hold one a task."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(key, None) is None:
        conf.set(key, str(ARROW_BYTES))
    return df


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
