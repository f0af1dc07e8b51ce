"""Tables cut from their lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a local master gets one
    under /tmp; anything else is refused, since executors would not see such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/checkpoints/evidora"
    return folder.rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut of lineage that
    survives the loss of any executor. ``release`` deletes what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def long_rows(spark: SparkSession, rows: int = 2000) -> None:
    """Send ``rows`` rows at a time to Python workers, for tables of whole texts: Spark's 10,000 take five times the
    memory in the executor and in the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def bucketed(df: DataFrame, path: str, buckets: int, keys: list[str], partition_by: str | None = None) -> DataFrame:
    """Write ``df`` at ``path``, dealt by hash of ``keys`` to ``buckets`` and sorted in each, and read it back; joins of such
    tables on the keys need no shuffle. df must be dealt that way itself, or each task writes every bucket."""
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).sortBy(*keys)
    name = f"evidora_{uuid.uuid4().hex}"
    (writer.partitionBy(partition_by) if partition_by else writer).saveAsTable(name)
    _TABLES.append((df.sparkSession, name))
    return df.sparkSession.table(name)


def bucketed_at(spark: SparkSession, path: str, schema: str, buckets: int, keys: list[str]) -> DataFrame:
    """A table that ``bucketed`` wrote at ``path``, perhaps in another session."""
    name = f"evidora_{uuid.uuid4().hex}"
    by = ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    _TABLES.append((spark, name))
    return spark.table(name)


def bitmap(keys: DataFrame, key: str, bits: int = 26) -> DataFrame:
    """(bucket, marks): a bit array of 2**bits places at most, 8 MB, in which the place of each key is set;
    its size does not depend on the number of keys."""
    place = F.pmod(F.col(key), F.lit(1 << bits)) + 1
    return keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("marks"))


def perhaps(rows: DataFrame, marks: DataFrame, key: str, bits: int = 26) -> DataFrame:
    """rows with a column ``perhaps``: false if the key is surely none of those marked. Rows are not shuffled;
    it only saves work, so that what it lets through must be joined exactly."""
    place = F.pmod(F.col(key), F.lit(1 << bits)) + 1
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("marks", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "bucket", "left")
    one = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1))
    return found.withColumn("perhaps", F.coalesce(one == 1, F.lit(False))).drop("bucket", "marks")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted with the rest by ``release``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with memory of its batches returned when a task ends, since Python workers live on."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
                trim(0)

    return once


def release(keep: int = 0) -> None:
    """Delete what ``written`` left, but for the last ``keep``. Call it once results are stored;
    it also runs when the process ends."""
    if not keep:
        for spark, name in _TABLES:
            with contextlib.suppress(Exception):
                spark.sql(f"DROP TABLE IF EXISTS {name}")
        _TABLES.clear()
    gone = _WRITTEN[: len(_WRITTEN) - keep]
    del _WRITTEN[: len(gone)]
    for spark, path in gone:
        with contextlib.suppress(Exception):  # the session may have ended
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


atexit.register(release)
