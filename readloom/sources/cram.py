"""CRAM at the level of containers: found, counted, selected and split, without decoding what they hold."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources import ranges

CONTAINERS = "path string, container long, offset long, size long, ref int, start int, span int, n long, counter long, bases long, blocks int, landmarks array<int>"
#: Last containers of versions 2 and 3, and the start that marks them (fixed values of the format).
ENDS = {
    2: "0B000000FFFFFFFFFFE0454F460000000001000001000606010001000100",
    3: "0F000000FFFFFFFF0FE0454F4600000000010005BDD94F0001000606010001000100EE63014B",
}
END_START = 4542278


def varint(b: bytes, at: int) -> tuple[int, int]:
    """A number of up to 32 bits (ITF-8), signed, and the place after it."""
    x = b[at]
    if x < 0x80:
        return x, at + 1
    if x < 0xC0:
        return (x & 0x3F) << 8 | b[at + 1], at + 2
    if x < 0xE0:
        return (x & 0x1F) << 16 | b[at + 1] << 8 | b[at + 2], at + 3
    if x < 0xF0:
        return (x & 0x0F) << 24 | int.from_bytes(b[at + 1 : at + 4], "big"), at + 4
    v = (x & 0x0F) << 28 | int.from_bytes(b[at + 1 : at + 4], "big") << 4 | b[at + 4] & 0x0F
    return v - (1 << 32) if v >> 31 else v, at + 5


def long_varint(b: bytes, at: int) -> tuple[int, int]:
    """A number of up to 64 bits (LTF-8), signed, and the place after it."""
    more = 8 - (b[at] ^ 0xFF).bit_length()  # ones at the front of the first byte
    v = b[at] & (0xFF >> (more + 1)) if more < 7 else 0
    v = v << 8 * more | int.from_bytes(b[at + 1 : at + 1 + more], "big")
    return v - (1 << 64) if v >> 63 else v, at + 1 + more


def _header(b: bytes, version: int) -> tuple[tuple, int]:
    """Fields of a container's header (bytes of its blocks, ref, start, span, n, counter, bases, blocks, landmarks) and the header's size. A version 3 header's checksum is verified."""
    size, at, got = struct.unpack_from("<i", b)[0], 4, []
    for read in (varint, varint, varint, varint, long_varint if version >= 3 else varint, long_varint, varint, varint):
        v, at = read(b, at)
        got.append(v)
    marks = []
    for _ in range(got.pop()):
        v, at = varint(b, at)
        marks.append(v)
    if version >= 3:
        if at + 4 > len(b):
            raise IndexError("header is longer than what was read")
        if zlib.crc32(b[:at]) != struct.unpack_from("<I", b, at)[0]:
            raise ValueError("the checksum of a container's header differs")
        at += 4
    return (size, *got, marks), at


def walk(f, length: int):
    """Containers of an open file, the first of which holds the file's header: (offset, size with its header, ref, start, span, n, counter, bases, blocks, landmarks), up to the end mark."""
    head = f.read(26)
    if head[:4] != b"CRAM":
        raise ValueError("not a CRAM file")
    version, at = head[4], 26
    while at < length:
        want = 1 << 10
        while True:
            f.seek(at)
            b = f.read(min(want, length - at))
            try:
                (size, *rest), own = _header(b, version)
                break
            except (IndexError, struct.error):
                if len(b) == length - at:
                    raise ValueError(f"the file ends within the container at {at}") from None
                want *= 8
        if rest[0] == -1 and rest[1] == END_START and not rest[3]:
            return
        if at + own + size > length:
            raise ValueError(f"the file ends within the container at {at}")
        yield (at, own + size, *rest)
        at += own + size


def containers(spark: SparkSession, path: str, opener: Callable = ranges.opened) -> DataFrame:
    """The containers of CRAM files, numbered from 0 (the file's header). A file's headers are read one after another, as each tells where the next is; what lies between is not read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    import pyarrow as pa

    to = to_arrow_schema(StructType.fromDDL(CONTAINERS))

    def run(batches):
        for b in batches:
            for path, length in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
                with opener(path) as f:
                    rows = [(path, i, *c) for i, c in enumerate(walk(f, length))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), to, strict=True)], schema=to)

    return ranges.tasks(spark, [(p, 0, n, n) for p, n in ranges.files(spark, path)]).mapInArrow(run, CONTAINERS)


def counts(found: DataFrame) -> DataFrame:
    """path, records, bases from headers alone."""
    return found.where("container > 0").groupBy("path").agg(F.sum("n").alias("records"), F.sum("bases").alias("bases"))


def overlapping(found: DataFrame, ref: int, start: int, stop: int) -> DataFrame:
    """Containers that can hold records overlapping start .. stop of a contig: its own that overlap, and those of several contigs (ref -2)."""
    own = (F.col("ref") == ref) & (F.col("start") <= stop) & (F.col("start").cast("long") + F.col("span") - 1 >= start)
    return found.where((F.col("container") > 0) & (own | (F.col("ref") == -2)))


def first(found: DataFrame, n: int) -> DataFrame:
    """The first n containers of each file."""
    return found.where(F.col("container").between(1, n))


def raw(found: DataFrame, parts: int = 200, opener: Callable = ranges.opened) -> DataFrame:
    """path, container, content: the bytes of containers as they are, read in up to `parts` tasks; a batch has one container."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for path, k, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with opener(path) as f:
                    f.seek(at)
                    got = f.read(size)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([got], pa.binary())], names=["path", "container", "content"])

    return found.select("path", "container", "offset", "size").repartitionByRange(parts, "path", "container").mapInArrow(run, "path string, container long, content binary")
