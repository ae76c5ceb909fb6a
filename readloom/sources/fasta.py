"""Stretches of FASTA files read by place: the index tells where a contig's lines lie, and only their bytes are read.

Plain files are entered at the byte, block-compressed ones at the block that holds it. `find_by_md5` looks
references up by checksum along a chain of path patterns.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import seq
from readloom.sources import bam, ranges

#: Letters of a sequence that the sanity check lets through (IUPAC codes, gaps), and how many it looks at.
LETTERS, CHECKED = frozenset(b"ACGTUNRYSWKMBDHVacgtunryswkmbdhv.-=*"), 1000


def block_places(f, length: int) -> list[tuple[int, int]]:
    """(place of the content, place in the file) of each block; only the ends of blocks are read."""
    out, at, inner = [], 0, 0
    while at < length:
        f.seek(at)
        head = f.read(18)
        if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
            raise ValueError(f"no block at {at}")
        size = struct.unpack_from("<H", head, 16)[0] + 1
        f.seek(at + size - 4)
        out.append((inner, at))
        inner += struct.unpack("<I", f.read(4))[0]
        at += size
    return out


def _each_file(paths: DataFrame, ddl: str, rows: Callable) -> DataFrame:
    """rows(path) of each distinct path, a task for each."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    to = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                got = rows(path)
                for at in range(0, len(got), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got[at : at + 10_000], strict=True), to, strict=True)], schema=to)

    return paths.select("path").where("path is not null").distinct().mapInArrow(run, ddl)


FAI = "path string, rname string, length long, first long, line_bases int, line_bytes int"
BLOCKS = "path string, inner long, size long, at long"


def indexes(paths: DataFrame, opener: Callable = ranges.opened) -> DataFrame:
    """The FASTA indexes beside files (`x.fai`), each file's own: path, rname, length, first, line_bases, line_bytes."""

    def rows(path):
        with opener(f"{path}.fai") as f:
            parts = [x.split("\t") for x in f.read().decode().splitlines() if x]
        return [(path, name, *map(int, numbers)) for name, *numbers in parts]

    return _each_file(paths, FAI, rows)


def blocks(paths: DataFrame, opener: Callable = ranges.opened) -> DataFrame:
    """The blocks of block-compressed files: path, inner (place of the content), size (of the content), at (place in the file). Plain files have none. A file is walked once, by one task."""

    def rows(path):
        with opener(path) as f:
            if f.read(2) != b"\x1f\x8b":
                return []
            f.seek(0, 2)
            length = f.tell()
            held = block_places(f, length)
            f.seek(length - 4)
        ends = [i for i, _ in held[1:]] + [held[-1][0]]  # the last one is the empty mark of the end
        return [(path, i, e - i, at) for (i, at), e in zip(held, ends, strict=True) if e > i]

    return _each_file(paths, BLOCKS, rows)


def _bytes(f, begin: int, stop: int, length: int, inner: int | None, at: int | None) -> bytes:
    """Content from begin to stop; of a compressed file from the block at `at` on, whose content begins at `inner`."""
    if at is None:
        f.seek(begin)
        return f.read(stop - begin)
    got = bytearray()
    for _, part in bam._blocks(f, at, length):
        got += part
        if inner + len(got) >= stop:
            break
    return bytes(got[begin - inner : stop - inner])


def stretches(fai: DataFrame, held: DataFrame, wanted: DataFrame, parts: int = 200, opener: Callable = ranges.opened) -> DataFrame:
    """rname, start, stop, seq of the stretches `wanted` (path, rname, start, stop; 1-based, both included) of any number of FASTA files, in capitals.

    A stop beyond the contig is its end; a contig that its file's index lacks, or a start beyond the contig, gives a null. fai: as indexes()
    gives it; held: the blocks of compressed files. Stretches are ordered by file and place in up to `parts` tasks, so that a task reads neighbouring bytes;
    each meets the block that it begins in by a join, by bins of a megabyte of content.
    """
    import pyarrow as pa

    w = wanted.select("path", "rname", "start", "stop")
    j = w.join(fai, ["path", "rname"], "left").withColumn("end", F.least("stop", "length").cast("long"))
    byte = lambda c: F.col("first") + F.expr(f"{c} div line_bases") * F.col("line_bytes") + F.col(c) % F.col("line_bases")
    inside = (F.col("start") >= 1) & (F.col("start") <= F.col("end"))
    j = j.withColumns({"a": (F.col("start") - 1).cast("long"), "b": F.col("end") - 1})
    j = j.select("path", "rname", "start", "stop", F.when(inside, byte("a")).alias("begin"), F.when(inside, byte("b") + 1).alias("until")).withColumn("bin", F.shiftright("begin", 20))
    h = held.withColumn("bin", F.explode(F.array_distinct(F.array(F.shiftright("inner", 20), F.shiftright(F.col("inner") + F.col("size") - 1, 20)))))
    h = h.select(F.col("path").alias("h_path"), F.col("bin").alias("h_bin"), "inner", "size", "at")
    j = j.join(h, (F.col("path") == F.col("h_path")) & (F.col("bin") == F.col("h_bin")) & (F.col("inner") <= F.col("begin")) & (F.col("begin") < F.col("inner") + F.col("size")), "left")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches):
        opened, now, length = None, None, 0
        try:
            for b in batches:
                rows = []
                for path, r, s, e, x, y, inner, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    text = None
                    if x is not None:
                        if path != now:  # a task's stretches are in order of files
                            if opened:
                                opened.close()
                            opened, now = opener(path), path
                            opened.seek(0, 2)
                            length = opened.tell()
                        text = _bytes(opened, x, y, length, inner, at).translate(None, b"\r\n").upper().decode("latin-1")
                    rows.append((r, s, e, text))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["rname", "start", "stop", "seq"])
        finally:
            if opened:
                opened.close()

    j = j.select("path", "rname", "start", "stop", "begin", "until", "inner", "at")
    return j.repartitionByRange(parts, "path", "begin").sortWithinPartitions("path", "begin").mapInArrow(run, "rname string, start long, stop long, seq string")


def regions(spark: SparkSession, path: str, fai: DataFrame, wanted: DataFrame, parts: int = 200, opener: Callable = ranges.opened) -> DataFrame:
    """stretches() of one FASTA file. wanted: rname, start, stop; fai: as text.read_fai gives it."""
    (name, _) = ranges.files(spark, path)[0]
    mine = spark.range(1).select(F.lit(name).alias("path"))
    own = fai.select(F.lit(name).alias("path"), "rname", F.col("length").cast("long").alias("length"), F.col("start").cast("long").alias("first"), "line_bases", "line_bytes")
    return stretches(own, blocks(mine, opener), wanted.select(F.lit(name).alias("path"), "rname", "start", "stop"), parts, opener)


def by_header(dictionary: DataFrame, wanted: DataFrame, parts: int = 200, opener: Callable = ranges.opened) -> DataFrame:
    """rname, start, stop, seq of stretches by a header's own references: each contig in the file that its UR names, by the index beside that file.

    dictionary: rname, ur (null: none known, which gives nulls). Local paths may come as plain paths or as file: URIs.
    """
    d = dictionary.select("rname", F.when(F.col("ur").contains("://") | F.col("ur").startswith("file:"), F.col("ur")).otherwise(F.concat(F.lit("file:"), F.col("ur"))).alias("path"))
    w = wanted.select("rname", "start", "stop").join(d, "rname", "left")
    # only files that are asked for are opened
    paths = d.join(wanted.select("rname").distinct(), "rname", "left_semi").select("path")
    return stretches(indexes(paths, opener), blocks(paths, opener), w, parts, opener)


def dictionary_of(header: DataFrame) -> DataFrame:
    """rname, length, md5, ur of a header's @SQ lines. header: one line in a row (`value`)."""
    field = lambda k: F.nullif(F.regexp_extract("value", rf"\t{k}:([^\t]*)", 1), F.lit("")).alias({"SN": "rname", "M5": "md5", "UR": "ur"}.get(k, k))
    return header.where("value like '@SQ%'").select(field("SN"), field("LN").cast("long").alias("length"), field("M5"), field("UR"))


def find_by_md5(wanted: DataFrame, patterns: list[str], tries: int = 2, opener: Callable = ranges.opened) -> DataFrame:
    """md5, path, seq of references by checksum: the first pattern (see seq.path_of) under whose path there is a sound file.

    A local file (no `://`) of another checksum is an error. A remote one is read again up to `tries` times, and passed over if its
    checksum still differs or its first letters are none of a sequence. What is found nowhere has nulls.
    """
    import pyarrow as pa

    def read(path):
        try:
            with opener(path) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def load(path, md5):
        for _ in range(tries if "://" in path else 1):
            data = read(path)
            if data is None:
                return None
            if hashlib.md5(data).hexdigest() == md5:
                return data if "://" not in path or LETTERS.issuperset(data[:CHECKED]) else None
            if "://" not in path:
                raise ValueError(f"the checksum of {path} differs")
        return None

    def run(batches):
        for b in batches:
            out = []
            for md5, paths in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hit = next(((p, d) for p in paths if (d := load(p, md5)) is not None), None) if md5 else None
                out.append((md5, *(hit or (None, None))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] and r[2].decode("latin-1") for r in out], pa.string())], names=["md5", "path", "seq"])

    m = F.lower("md5")
    return wanted.select(m.alias("md5"), F.array(*(seq.path_of(p, m) for p in patterns)).alias("paths")).mapInArrow(run, "md5 string, path string, seq string")
