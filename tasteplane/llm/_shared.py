"""Scratch tables, size-checked broadcasts and file-system calls shared by the operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two longs or a short string each that an executor holds without strain (a few MB).
BROADCAST_ROWS = 50_000

_own: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tasteplane-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Files of a small table, where the cluster has no more cores.
FEW_FILES = 12


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in a partition for each core of the cluster (FEW_FILES at least), if it has more.

    For results of an aggregation that are small beside its input: where the session does not merge small
    shuffle partitions, each would be a file of some rows, and Hadoop's local file system starts processes for each file.
    No rows are dealt anew, so no shuffle is added; the tasks that are merged hold the aggregate's last step only.
    """
    return df.coalesce(max(FEW_FILES, df.sparkSession.sparkContext.defaultParallelism))


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no result reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            remove(table.sparkSession, file.rpartition("/")[0])


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that ``stored`` has made in this process; for when their results have been written elsewhere."""
    while _made:
        remove(spark, _made.pop())


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only when a count proves that it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: rows of an Arrow batch: texts may be long, and both sides hold some batches at once
ARROW_ROWS = 1_000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def give_back() -> None:
    """Return what a task has freed to the system: Python workers are used again, and idle ones should hold little."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in small batches (the session's setting is lowered to ARROW_ROWS if it is higher)."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ARROW_ROWS)) <= ARROW_ROWS:
        conf.set(_ARROW_ROWS, str(ARROW_ROWS))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, lengthened until no column of ``tables`` has it (whatever its case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: bits of the filter that ``may_be_in`` broadcasts: 2 MB, whatever the tables
_FILTER_BITS = 1 << 24


def may_be_in(rows: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of which ``column`` may be among ``wanted``'s ``key``: few others, so the exact join that follows ships less.

    The filter is a bit map of FILTER_BITS bits over hashes, so its broadcast is bounded; where wanted
    keys fill it, it passes all rows and the join alone decides.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(_FILTER_BITS))
    number, bits = unused("_number", rows), unused("_bits", rows)
    at = place(F.col(key)) + 1  # bitmap numbers count from 1
    maps = wanted.groupBy(F.bitmap_bucket_number(at).alias(number)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    own = place(F.col(column)) + 1
    bit = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring(F.col(bits), (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    found = rows.join(F.broadcast(maps), F.bitmap_bucket_number(own) == F.col(number))
    return found.filter(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0).select(*[F.col(f"`{c}`") for c in rows.columns])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
