"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one, on a local master only."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(found)
        found = context.getCheckpointDir()
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit, or a folder; the others go still
            continue


atexit.register(_clean)


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared folder; it goes when the process ends."""
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds the session's Arrow batches: those of ten thousand long texts would fill several workers' memory."""
    if int(spark.conf.get(BATCH_BYTES).rstrip("b")) > most:
        spark.conf.set(BATCH_BYTES, str(most))


def table(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a cut in the lineage that any executor can read.

    batch_bytes bounds the Arrow batches that go to Python meanwhile.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(BATCH_BYTES)
    if batch_bytes:
        spark.conf.set(BATCH_BYTES, str(batch_bytes))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table() that is needed no more."""
    remove(df.sparkSession, df._lodestone_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """Removes, at its end, the tables that were written inside, but for those given to the function it yields."""
    first, kept = len(_made), []
    yield lambda df: kept.append(df._lodestone_path)
    for _, path in _made[first:]:
        if path not in kept:
            remove(spark, path)
