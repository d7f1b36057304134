"""What several corpus operators share: words, staging in the shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a maximal run of these characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table of a few narrow columns may be broadcast (tens of MB).
BROADCAST_ROWS = 1_000_000
#: Bytes and rows of one Arrow batch handed to Python, at most; a longer text is a batch of its own.
ARROW_BATCH_BYTES = 8 << 20
ARROW_BATCH_ROWS = 2000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(column, _UPPER, _UPPER.lower())


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text modulo n; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % n


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


_records: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of what is staged inside; those that are still listed at the end go on to the list around this one."""
    own: list[str] = []
    _records.append(own)
    try:
        yield own
    finally:
        _records.pop()
        if _records:
            _records[-1].extend(own)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder, which goes when the application ends, or before by ``release``."""
    folder = f"{shared_folder(spark)}/bindlattice-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    if _records:
        _records[-1].append(folder)
    return folder


def release(spark: SparkSession, folders: list[str], kept: DataFrame) -> None:
    """Remove the folders that ``kept`` does not read from the list and the disk."""
    files = kept.inputFiles() if folders else []
    read = [f for f in folders if any(f.rpartition("/")[2] in file for file in files)]
    for folder in set(folders) - set(read):
        _remove(spark, folder)
    folders[:] = read


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark find the plans that are gone, whose shuffle files go then."""
    gc.collect()
    with contextlib.suppress(Exception):
        spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage as checkpoint() does, but keeps column pruning; the
    files survive lost executors and go when the application ends.
    """
    spark = df.sparkSession
    path = f"{new_folder(spark)}/{name}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    trim()
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if it was counted to have at most ``rows`` rows."""
    fits = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if fits else df), fits


def give_back() -> None:
    """Return the memory that a task freed to the system; workers live on between tasks."""
    gc.collect()
    trim()


def trim() -> None:
    """Return free memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _then_give_back(batches: Iterator[pa.RecordBatch], each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    try:
        yield from each(batches)
    finally:
        give_back()


def arrow_map(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of bounded bytes."""
    with contextlib.suppress(Exception):
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    return df.mapInArrow(partial(_then_give_back, each=each), schema)


def batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
