"""Byte ranges of files: what a task needs to read a part of a large binary file.

Files are listed by Spark and opened by Arrow's file systems (local, HDFS, S3, GCS, ABFS). For other
stores an opener can be given: a function of a path that returns a seekable binary file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = 64 << 20


def opened(path: str):
    """A file open for reading at any place."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files at a path or pattern: a listing, no content is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at a path or pattern, by path."""
    return sorted((r.path, r.length) for r in listing(spark, path).collect())


def tasks(spark: SparkSession, rows: list[tuple[str, int, int, int]]) -> DataFrame:
    """part, path, begin, stop, length: one task for each range (path, begin, stop, length)."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "part long, path string, begin long, stop long, length long")
    return df.repartitionById(max(1, len(rows)), F.col("part").cast("int"))


def splits(spark: SparkSession, path: str, size: int = SPLIT) -> DataFrame:
    """Ranges of at most `size` bytes of all files, as of tasks(), by path and place: each range a task of its own.

    They are made from the listing, of which the driver learns their number alone; one row for each file is put in order. An empty file has none.
    """
    found = listing(spark, path).where("length > 0").withColumn("n", F.expr(f"(length + {size - 1}) div {size}"))
    count = found.agg(F.sum("n")).collect()[0][0] or 0
    before = F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = found.withColumn("before", before).select("before", "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    begin = F.col("k") * size
    out = each.select((F.col("before") + F.col("k")).alias("part"), "path", begin.alias("begin"), F.least(begin + size, "length").alias("stop"), "length")
    return out.repartitionById(max(1, count), F.col("part").cast("int"))


def edges(spark: SparkSession, path: str, first: int, last: int, opener: Callable = opened) -> DataFrame:
    """path, length, head, tail: the first and last bytes of each file."""
    import pyarrow as pa

    names = ["path", "length", "head", "tail"]

    def run(batches):
        for b in batches:
            rows = []
            for p, n in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
                with opener(p) as f:
                    head = f.read(min(first, n))
                    f.seek(max(0, n - last))
                    rows.append((p, n, head, f.read(min(last, n))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.binary(), pa.binary())], names=names)

    return tasks(spark, [(p, 0, n, n) for p, n in files(spark, path)]).mapInArrow(run, "path string, length long, head binary, tail binary")
