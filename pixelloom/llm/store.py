"""Tables and files in the folder that driver and executors share.

The cluster names it in ``spark.checkpoint.dir``. Only under a local master, where that setting is
missing in tests, a folder of the session's own is made and kept in the setting.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.llm.text import fresh


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, as a URI. Nothing is created."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = f"file://{tempfile.mkdtemp(prefix='pixelloom-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}" if root.startswith("/") and spark.sparkContext.master.startswith("local") else root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read from there: computed once, lineage cut, safe to lose executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table up to so many rows of a few numbers (tens of MB at most) may be broadcast.
SMALL_ROWS = 500_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, which are counted; else as it is.

    The join then shuffles both sides, and adaptive execution splits skewed partitions. ``df`` should be
    cheap to read, such as a ``written`` table, and have narrow rows.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the position of each row in ``order`` from 0, without one task that sorts all.

    Rows are dealt by range and numbered within their partition; the counts of earlier partitions are added.
    Rows that ``order`` does not tell apart get positions in any order, fixed once as the result is written.
    """
    part, here = fresh(df, "__part", "__here")
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn(here, F.monotonically_increasing_id()), "positions")
    dealt = dealt.withColumn(part, F.shiftright(here, 33)).withColumn(here, F.col(here).bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("__n")).select(
        part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (dealt.join(F.broadcast(starts), part).withColumn(name, F.col(here) + F.col("__start"))
            .drop(part, here, "__start"))


def put_bytes(uri: str, data: bytes) -> None:
    """Write a whole file in a task; the folder is made if need be. A retry writes another name or the same bytes."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(data)


def create_file(uri: str) -> pa.NativeFile:
    """A new file for writing in a task; the folder is made if need be."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


@contextmanager
def narrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Within it, jobs hand Arrow batches of about ``size`` bytes to Python; the session's own settings come back after."""
    names = {"spark.sql.execution.arrow.maxBytesPerBatch": str(size),
             "spark.sql.execution.arrow.maxRecordsPerBatch": str(max(1, size >> 12))}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def open_file(uri: str) -> pa.NativeFile:
    """A seekable file for reading in a task."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)
