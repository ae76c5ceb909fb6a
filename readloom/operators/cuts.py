"""Cutting a plan at the shared checkpoint folder, and numbering rows in order without a window over all of them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set a session in one process (as in tests) gets one of its own; on a cluster that is an error, as a folder of the driver's machine would not be shared."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="readloom-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read on from there, so later steps neither recompute it nor lose it with an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ours in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column], slices: int | None = None) -> DataFrame:
    """df with sums of columns over all rows up to each one in the given order.

    Rows are dealt into ranges of the order and summed within each, and the ranges start where those before them end: one small
    row for each range is all that one task ever orders. Rows equal in the order share a range and come in any order.
    """
    ranged = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    ranged = cut(ranged.withColumns({f"__v_{k}": c for k, c in sums.items()} | {"__slice": F.spark_partition_id()}))
    size = ranged.groupBy("__slice").agg(*(F.sum(f"__v_{k}").alias(f"__s_{k}") for k in sums))
    ahead = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    base = size.select("__slice", *(F.coalesce(F.sum(f"__s_{k}").over(ahead), F.lit(0)).alias(f"__b_{k}") for k in sums))  # one row for each range
    upto = Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.select("*", *(F.sum(f"__v_{k}").over(upto).alias(f"__u_{k}") for k in sums))
    return inside.join(F.broadcast(base), "__slice").select(*df.columns, *((F.col(f"__b_{k}") + F.col(f"__u_{k}")).alias(k) for k in sums))


def numbered(df: DataFrame, order: list[Column | str], name: str = "place", slices: int | None = None) -> DataFrame:
    """df with `name`: 1, 2, ... in the given order; see running()."""
    return running(df, order, {name: F.lit(1).cast("long")}, slices)
