"""What the operators of this subpackage share: durable intermediate tables and word splitting."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space ones.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Bytes of an Arrow batch on its way to a Python worker; Spark's own default is eight times as much.
ARROW_BYTES = 8 << 20

#: What Python workers remember between tasks, by operator: how to drop it.
caches: dict[str, Callable[[], None]] = {}

_written: list[tuple[SparkSession, str]] = []
#: Tables that the ``settled`` calls of this thread have written so far.
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a local session may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage so that a lost executor costs a read, not a recomputation, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_sweep, _written)
    _written.append((spark, path))
    for mine in getattr(_open, "calls", []):
        mine.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = spark, path
    return out


def settled(make: Callable[[], DataFrame], spent: DataFrame | None = None) -> DataFrame:
    """The result of ``make`` as a durable table. The durable tables that it wrote on the way, and ``spent``, are deleted."""
    _open.calls = [*getattr(_open, "calls", []), mine := []]
    try:
        out = durable(make())
        _sweep(mine[:-1])
        _sweep([s] if spent is not None and (s := vars(spent).get("_stored")) else [])
    finally:
        _open.calls = _open.calls[:-1]
    return out


def _sweep(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone by now
            return


def keep_only(owner: str = "") -> None:
    """Drop what the other operators left in this Python worker: a worker serves one after the other."""
    for name, drop in caches.items():
        if name != owner:
            drop()


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs`` as they are. Where the session doesn't say how large Arrow batches are, they stay small from now on.

    Executor and worker each hold a whole batch of texts a task, beside what the operator needs.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", docs.sparkSession.conf
    if conf.get(key, None) is None:
        conf.set(key, str(ARROW_BYTES))
    return docs


def trim() -> None:
    """Give freed memory back to the system, so that an idle worker leaves room for the next operator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        return


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A partition function that forgets what it remembered when its partition ends."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for drop in caches.values():
                drop()
            trim()

    return inner


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, where a lambda in ``use`` would evaluate it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """The words of ``text``; an empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
