"""Shared storage between phases: tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary folder in local mode (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a shared folder")
        found = f"file://{tempfile.mkdtemp(prefix='divit-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python a few megabytes at a time, however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def trimmed(run: Callable) -> Callable:
    """An Arrow function whose worker gives freed memory back to the system when a task ends, as workers live on between stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def quoted(column: str) -> str:
    """A column's name for F.col, whatever it holds."""
    return "`" + column.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has (names don't differ by case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settle(df: DataFrame, label: str, codec: str = "none") -> DataFrame:
    """Write a phase's rows to the shared folder and read them back: cuts the lineage and survives lost executors.

    Without a codec as a rule: most rows are hashes, which nothing compresses, and codecs hold memory outside the heap.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/divit/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """settle() for rows that are dealt out to n partitions by `key`: what joins or groups them by it later need not move them again."""
    return settle_turns_by([df], label, key, n)


def settle_turns_by(frames: Iterable[DataFrame], label: str, key: str, n: int) -> DataFrame:
    """settle_by() for frames of like columns that are written one after the other, so that only one is on the move at a time. At least one."""
    name = f"divit_{label}_{uuid.uuid4().hex}"
    for df in frames:
        spark = df.sparkSession
        df.write.mode("append").option("compression", "none").option("path", f"{shared_dir(spark)}/divit/{name}").format("parquet").bucketBy(n, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the name alone: the files are outside the catalogue's folder
    return table


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written inside has its shuffle files removed as soon as it ends; else they stay until the driver collects garbage and the cleaner gets to them.

    Not for frames that are evaluated more than once inside: write them with settle().
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished phases."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(df: DataFrame) -> None:
    """Delete a table made by settle() that no later phase reads."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
