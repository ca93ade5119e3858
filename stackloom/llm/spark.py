"""Spark helpers of this subpackage: cutting lineage, components of a graph, numbered blocks."""

from __future__ import annotations

import atexit
import contextlib
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    path = known.get() if known.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="stackloom-")
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Cuts lineage with a written table in the shared folder: what executors lose can be read again.

    Parquet takes a fraction of a checkpoint's room.  `instead_of`: a table of an earlier cut that
    nothing needs any more once this one is written.  The others go when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stackloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    if instead_of is not None:
        _delete(spark, instead_of._cut_at)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(ValueError):
        _made.remove((spark, path))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def let_go(spark: SparkSession) -> None:
    """Collects garbage on the driver, so that Spark drops shuffles, broadcasts and plans that nothing refers to.

    It does so by itself only when the heap is full or after ``spark.cleaner.periodicGC.interval``;
    rounds of joins fill heap and disks much sooner.
    """
    gc.collect()  # Python's references keep the JVM's objects
    spark._jvm.java.lang.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in list(_made):
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(spark, path)


def unused(df: DataFrame, name: str) -> str:
    """`name`, or with as many underscores as it takes not to be a column of df (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy(run: Callable) -> Callable:
    """For mapInArrow: gives memory that the function has used back to the system when its task ends.

    Python workers live on between tasks; what their allocators hold would count beside the next one's.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        from stackloom.llm import kernel

        try:
            yield from run(batches)
        finally:
            kernel.forget()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, name: str, *by: Column | str) -> DataFrame:
    """df with a number from 0 in the order of `by`, in two phases: places within ranges, and how many rows the ranges before have.

    No task sees more than a range of the rows; rows that are equal in `by` fall into one range.
    """
    at, first, keys = unused(df, "range"), unused(df, "first"), [F.col(k) if isinstance(k, str) else k for k in by]
    ranges = cut(df.repartitionByRange(parts(df.sparkSession), *keys).withColumn(at, F.spark_partition_id()))
    # a row for each range
    before = ranges.groupBy(at).agg(F.count("*").alias(first)).withColumn(first, F.sum(first).over(Window.orderBy(at)) - F.col(first))
    place = F.row_number().over(Window.partitionBy(at).orderBy(*keys)) - 1
    return ranges.withColumn(name, place).join(before, at).withColumn(name, (F.col(name) + F.col(first)).cast("bigint")).drop(at, first)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of (a, b) bigint pairs: (node, component), component the least node.

    Alternates large-star and small-star steps; each keeps at most one row per edge, hubs are
    pre-aggregated before the shuffle, and lineage is cut after every round.  Nodes without an
    edge are not in the result; loops are ignored; an empty input gives an empty result.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = cut(small.unionAll(down.select("a", F.col("m").alias("b"))).distinct(), instead_of=e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    let_go(edges.sparkSession)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
