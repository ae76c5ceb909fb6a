"""Files sealed in blocks, so that any stretch can be opened by itself.

A sealed file is a folder of parts, each written by one task: a part holds up to `blocks` blocks, one behind the other, each the AES-GCM sealing of `block` bytes of
the file (12 bytes of its own nonce before it, 16 of a tag behind it). A block is bound to the file's mark, its number and whether it is the
last one, so a block that is changed, moved, taken from another file or cut off isn't opened but is an error. Where a block lies
follows from its number; a stretch reads only the blocks that it touches. Sealing and opening are done by the engine.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources import datasource, ranges

BLOCK, BLOCKS = 1 << 16, 1024
OVER = 28
_NOTE = "sealed.json"


def _bound(mark, number, last):
    """What a block is bound to."""
    return F.concat_ws(":", mark, number.cast("string"), last.cast("string"))


def seal(spark: SparkSession, path: str, folder: str, key: str, block: int = BLOCK, blocks: int = BLOCKS, opener: Callable = ranges.opened) -> int:
    """Seal the files at a path, each into a folder of its name (empty files aren't listed, and left out); returns the number of parts. key: 16, 24 or 32 characters."""
    size = block * blocks

    def cut(batches):
        for b in batches:
            for _, p, begin, stop, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with opener(p) as f:
                    f.seek(begin)
                    for at in range(begin, stop, block):
                        data = f.read(min(block, stop - at))
                        yield pa.RecordBatch.from_pydict({"name": [p.rpartition("/")[2]], "length": [length], "part": [begin // size], "number": [at // block], "last": [at + block >= length], "content": pa.array([data], pa.binary())})

    made = ranges.splits(spark, path, size).mapInArrow(cut, "name string, length long, part long, number long, last boolean, content binary")
    mark = F.concat_ws("/", "name", F.col("length").cast("string"))
    closed = F.aes_encrypt("content", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), _bound(mark, F.col("number"), F.col("last")))
    made = made.select("name", "length", "part", "number", closed.alias("content"))

    def write(batches):
        sink, now, n = None, None, 0
        for b in batches:
            for name, length, part, _, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (name, part) != now:
                    if sink:
                        done(sink)
                    sink, now, n = start(name, part, length), (name, part), n + 1
                sink[0].write(content)
        if sink:
            done(sink)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    def start(name, part, length):
        import uuid

        system, inner = datasource._system(f"{folder}/{name}/part-{part:010d}")
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        if not part:
            with system.open_output_stream(inner.rpartition("/")[0] + "/" + _NOTE) as note:
                note.write(json.dumps({"length": length, "block": block, "blocks": blocks}).encode())
        aside = f"{inner}.{uuid.uuid4().hex}"
        return system.open_output_stream(aside), system, aside, inner

    def done(sink):
        sink[0].close()
        sink[1].move(sink[2], sink[3])

    # rows of a part come from one task, in order, so each part is written as it is made
    return made.mapInArrow(write, "n long").agg(F.sum("n")).collect()[0][0] or 0


def opened(spark: SparkSession, folder: str, key: str, begin: int = 0, stop: int | None = None, per_task: int = 256, opener: Callable = ranges.opened) -> DataFrame:
    """name, begin, content of the sealed files in a folder, from a place to another one (None: the end): a row for each block that the stretch touches, cut to the stretch. Blocks that don't hold together are an error."""
    notes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _NOTE).load(folder)
    said = F.from_json(F.col("content").cast("string"), "length long, block long, blocks long")
    n = notes.select(F.regexp_replace("path", f"/{_NOTE}$", "").alias("name"), said.alias("s")).select("name", "s.*")
    upto = F.least(F.col("length"), F.lit(stop if stop is not None else (1 << 62)))
    n = n.withColumn("upto", upto).where((F.col("upto") > begin) | ((F.col("length") == 0) & (F.lit(begin) == 0)))
    first, last = F.floor(F.lit(begin) / F.col("block")), F.floor(F.greatest(F.col("upto") - 1, F.lit(0)) / F.col("block"))
    asked = n.withColumn("at", F.explode(F.sequence(first, last, F.lit(per_task).cast("long")))).withColumn("end", F.least(F.col("at") + per_task - 1, last))
    tasks = max(1, min(asked.count(), 10_000))

    def run(batches):
        for b in batches:
            for name, length, block, blocks, at, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                now, f = None, None
                for k in range(at, end + 1):
                    part, i = divmod(k, blocks)
                    if part != now:
                        if f:
                            f.close()
                        f, now = opener(f"{name}/part-{part:010d}"), part
                    f.seek(i * (block + OVER))
                    size = max(0, min(block, length - k * block))
                    yield pa.RecordBatch.from_pydict({"name": [name], "length": [length], "block": [block], "number": [k], "last": [(k + 1) * block >= length], "content": pa.array([f.read(size + OVER)], pa.binary())})
                if f:
                    f.close()

    got = asked.select("name", "length", "block", "blocks", "at", "end").repartition(tasks, "name", "at").mapInArrow(run, "name string, length long, block long, number long, last boolean, content binary")
    mark = F.concat_ws("/", F.element_at(F.split("name", "/"), -1), F.col("length").cast("string"))
    plain = F.aes_decrypt("content", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _bound(mark, F.col("number"), F.col("last")))
    got = got.withColumn("plain", plain).withColumns({"low": F.col("number") * F.col("block")})
    skip = F.greatest(F.lit(begin) - F.col("low"), F.lit(0))
    take = F.least(F.col("low") + F.col("block"), F.least(F.col("length"), F.lit(stop if stop is not None else (1 << 62)))) - F.col("low") - skip
    return got.select("name", (F.col("low") + skip).alias("begin"), F.substring("plain", (skip + 1).cast("int"), take.cast("int")).alias("content"))


def packed_size(length: int, block: int = BLOCK) -> int:
    """Bytes of all parts of a sealed file."""
    return length + OVER * max(1, -(-length // block))
