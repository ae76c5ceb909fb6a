"""CRAM containers, slices and blocks as bytes: written, parsed, put together into files, and indexed by place in the file.

What lies inside a slice's data blocks is passed on as it is; their encodings are not part of this. With the framing alone, containers of many files are
put into one file (record counters and checksums are made anew) and an index by bytes is made of any file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.cuts import running
from readloom.sources import cram, ranges

#: Kinds of blocks, and how their data are packed (fixed values of the format).
FILE_HEADER, COMPRESSION_HEADER, SLICE, EXTERNAL, CORE = 0, 1, 2, 4, 5
RAW, GZIP = 0, 1
#: A slice of several contigs.
SEVERAL = -2


def itf8(x: int) -> bytes:
    """A number of up to 32 bits, signed: cram.varint() reads it."""
    x &= 0xFFFFFFFF
    if x < 1 << 7:
        return bytes([x])
    if x < 1 << 14:
        return bytes([0x80 | x >> 8, x & 0xFF])
    if x < 1 << 21:
        return bytes([0xC0 | x >> 16]) + (x & 0xFFFF).to_bytes(2, "big")
    if x < 1 << 28:
        return bytes([0xE0 | x >> 24]) + (x & 0xFFFFFF).to_bytes(3, "big")
    return bytes([0xF0 | x >> 28]) + (x >> 4 & 0xFFFFFF).to_bytes(3, "big") + bytes([x & 0x0F])


def ltf8(x: int) -> bytes:
    """A number of up to 64 bits, signed: cram.long_varint() reads it."""
    x &= (1 << 64) - 1
    for more in range(8):
        if x < 1 << 7 * (more + 1):
            lead = (0xFF << (8 - more)) & 0xFF
            return bytes([lead | x >> 8 * more]) + (x & (1 << 8 * more) - 1).to_bytes(more, "big") if more else bytes([x])
    return b"\xff" + x.to_bytes(8, "big")


def block(kind: int, content_id: int, data: bytes, version: int = 3) -> bytes:
    """A block; packed where that makes it shorter."""
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    small = packed.compress(data) + packed.flush()
    method, body = (GZIP, small) if len(small) < len(data) else (RAW, data)
    out = bytes([method, kind]) + itf8(content_id) + itf8(len(body)) + itf8(len(data)) + body
    return out + struct.pack("<I", zlib.crc32(out)) if version >= 3 else out


def read_block(b: bytes, at: int, version: int = 3) -> tuple[int, int, bytes, int]:
    """Kind, content id and data of the block at a place, and the place after it. A checksum that differs is an error; packings other than gzip are too."""
    begin, method, kind = at, b[at], b[at + 1]
    content_id, at = cram.varint(b, at + 2)
    packed, at = cram.varint(b, at)
    size, at = cram.varint(b, at)
    body, at = b[at : at + packed], at + packed
    if len(body) < packed:
        raise ValueError(f"the data end within the block at {begin}")
    if version >= 3:
        if zlib.crc32(b[begin:at]) != struct.unpack_from("<I", b, at)[0]:
            raise ValueError(f"the checksum of the block at {begin} differs")
        at += 4
    if method not in (RAW, GZIP):
        raise ValueError(f"packing {method} of the block at {begin} isn't known here")
    data = zlib.decompress(body, 31) if method == GZIP else bytes(body)
    if len(data) != size:
        raise ValueError(f"the block at {begin} holds {len(data)} bytes and not {size}")
    return kind, content_id, data, at


@dataclass
class Slice:
    """A slice's header, and its data blocks as bytes."""

    ref: int
    start: int
    span: int
    n: int
    counter: int = 0
    ids: list[int] = field(default_factory=list)
    embedded: int = -1
    md5: bytes = bytes(16)
    blocks: list[bytes] = field(default_factory=list)
    tags: bytes = b""  # what may follow in the header

    def header(self, version: int = 3) -> bytes:
        numbers = [self.ref, self.start, self.span, self.n]
        out = b"".join(map(itf8, numbers)) + (ltf8 if version >= 3 else itf8)(self.counter) + itf8(len(self.blocks)) + itf8(len(self.ids)) + b"".join(map(itf8, self.ids))
        return out + itf8(self.embedded) + self.md5 + self.tags

    def bytes(self, version: int = 3) -> bytes:
        return block(SLICE, 0, self.header(version), version) + b"".join(self.blocks)


def slice_header(data: bytes, version: int = 3) -> Slice:
    """The header in a slice's first block."""
    at, got = 0, []
    for k in range(7):
        v, at = (cram.long_varint if k == 4 and version >= 3 else cram.varint)(data, at)
        got.append(v)
    ids = []
    for _ in range(got[6]):
        v, at = cram.varint(data, at)
        ids.append(v)
    embedded, at = cram.varint(data, at)
    out = Slice(*got[:5], ids, embedded, data[at : at + 16])
    out.blocks, out.tags = [b""] * got[5], data[at + 16 :]
    return out


def container(slices: list[Slice], compression: bytes, counter: int, bases: int, version: int = 3) -> bytes:
    """A container's bytes: its header, the compression header's block, and the slices at their landmarks. Slices of one contig make a container of it, others one of several."""
    first = block(COMPRESSION_HEADER, 0, compression, version)
    parts, marks, at, n = [first], [], len(first), counter
    for s in slices:
        s.counter = n
        n += s.n
        marks.append(at)
        parts.append(s.bytes(version))
        at += len(parts[-1])
    refs = {s.ref for s in slices}
    ref = refs.pop() if len(refs) == 1 else SEVERAL
    start = min((s.start for s in slices), default=0) if ref >= 0 else 0
    span = max(s.start + s.span for s in slices) - start if ref >= 0 else 0
    blocks = 1 + sum(1 + len(s.blocks) for s in slices)
    return container_header(at, ref, start, span, sum(s.n for s in slices), counter, bases, blocks, marks, version) + b"".join(parts)


def container_header(size: int, ref: int, start: int, span: int, n: int, counter: int, bases: int, blocks: int, marks: list[int], version: int = 3) -> bytes:
    out = struct.pack("<i", size) + b"".join(map(itf8, (ref, start, span, n))) + (ltf8 if version >= 3 else itf8)(counter) + ltf8(bases) + itf8(blocks) + itf8(len(marks)) + b"".join(map(itf8, marks))
    return out + struct.pack("<I", zlib.crc32(out)) if version >= 3 else out


def file_start(text: str, version: int = 3, name: bytes = b"", room: int = 0) -> bytes:
    """The file's definition and the container of its header text, with room for a longer text."""
    raw = text.encode()
    held = block(FILE_HEADER, 0, struct.pack("<i", len(raw)) + raw + bytes(room), version)
    head = container_header(len(held), 0, 0, 0, 0, 0, 0, 1, [0], version)
    return b"CRAM" + bytes([version, 0]) + name[:20].ljust(20, b"\0") + head + held


def header_text(f, length: int) -> tuple[str, int, int]:
    """Header text of an open file, the place after its container, and the version."""
    version = f.read(6)[4]
    f.seek(0)
    at, size, *_ = next(cram.walk(f, length))
    f.seek(at)
    b = f.read(size)
    _, own = cram._header(b, version)
    _, _, data, _ = read_block(b, own, version)
    n = struct.unpack_from("<i", data)[0]
    return data[4 : 4 + n].decode(), at + size, version


def slices_of(b: bytes, version: int):
    """(landmark, bytes, header) of a container's slices, of its bytes."""
    (size, _, _, _, _, _, _, _, marks), own = cram._header(b, version)
    for k, mark in enumerate(marks):
        stop = marks[k + 1] if k + 1 < len(marks) else size
        _, _, data, _ = read_block(b, own + mark, version)
        yield mark, stop - mark, slice_header(data, version)


INDEX = "path string, seq_id int, start int, span int, container_offset long, slice_offset int, size int, records int, slice int"


def byte_index(spark: SparkSession, path: str, spans: DataFrame | None = None, opener: Callable = ranges.opened) -> DataFrame:
    """The index of CRAM files by bytes, a row for each slice: the place of its container in the file, of the slice from the end of the container's header on, and its size.

    spans: path, container_offset, slice, seq_id, start, span of the contigs of slices of several, which only their records tell; such a slice has a
    row for each. Without them it has one row, of contig -2.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    to = to_arrow_schema(StructType.fromDDL(INDEX))

    def run(batches):
        for b in batches:
            for path, length in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
                with opener(path) as f, opener(path) as g:
                    version = g.read(6)[4]
                    for k, (at, size, *_) in enumerate(cram.walk(f, length)):
                        if not k:
                            continue  # the file's header
                        g.seek(at)
                        rows = [(path, s.ref, s.start, s.span, at, mark, n, s.n, i) for i, (mark, n, s) in enumerate(slices_of(g.read(size), version))]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), to, strict=True)], schema=to)

    found = ranges.tasks(spark, [(p, 0, n, n) for p, n in ranges.files(spark, path)]).mapInArrow(run, INDEX)
    if spans is None:
        return found
    own = spans.select("path", "container_offset", "slice", F.col("seq_id").alias("s_id"), F.col("start").alias("s_start"), F.col("span").alias("s_span"))
    both = found.join(own, ["path", "container_offset", "slice"], "left")
    several = (F.col("seq_id") == SEVERAL) & F.col("s_id").isNotNull()
    pick = lambda a, b: F.when(several, F.col(b)).otherwise(F.col(a)).alias(a)
    return both.where((F.col("seq_id") == SEVERAL) | F.col("s_id").isNull()).select("path", pick("seq_id", "s_id"), pick("start", "s_start"), pick("span", "s_span"), "container_offset", "slice_offset", "size", "records", "slice")


def joined(spark: SparkSession, paths: list[str], text: str, opener: Callable = ranges.opened) -> DataFrame:
    """place, content: the pieces of one file of all containers of several files, in their order: the start with a header text, every container with its records numbered on through the files, and the end mark.

    Containers are read and made by tasks, a row each; their numbers are sums by ranges. Files must be of version 3 and have the same contigs.
    """
    order = {p: k for k, p in enumerate(paths)}
    found = None
    for p in paths:
        one = cram.containers(spark, p, opener).where("container > 0").withColumn("file", F.lit(order[p]))
        found = one if found is None else found.union(one)
    counted = running(found.select("path", "file", "container", "offset", "size", F.col("n").cast("long").alias("n")), ["file", "container"], {"upto": F.col("n"), "place": F.lit(1).cast("long")})

    def run(batches):
        for b in batches:
            for path, at, size, n, upto, place in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with opener(path) as f:
                    f.seek(at)
                    yield pa.RecordBatch.from_pydict({"place": [place], "content": [renumbered(f.read(size), upto - n)]})

    body = counted.select("path", "offset", "size", "n", "upto", "place").mapInArrow(run, "place long, content binary")
    edges = spark.createDataFrame([(0, bytearray(file_start(text))), ((1 << 62), bytearray(bytes.fromhex(cram.ENDS[3])))], "place long, content binary")
    return body.union(edges)


def renumbered(b: bytes, counter: int, version: int = 3) -> bytes:
    """A container's bytes with its records numbered from `counter` on: its header and its slices' headers are made anew, data blocks stay as they are."""
    (size, ref, start, span, n, _, bases, blocks, marks), own = cram._header(b, version)
    body, at, out, moved, first = b[own : own + size], 0, [], [], counter
    for k, mark in enumerate(marks):
        out.append(body[at:mark])
        stop = marks[k + 1] if k + 1 < len(marks) else len(body)
        _, _, data, after = read_block(body, mark, version)
        s = slice_header(data, version)
        s.counter, counter = counter, counter + s.n
        moved.append(sum(map(len, out)))
        out += [block(SLICE, 0, s.header(version), version), body[after:stop]]
        at = stop
    out.append(body[at:])
    whole = b"".join(out)
    return container_header(len(whole), ref, start, span, n, first, bases, blocks, moved, version) + whole


def containers_of(slices: DataFrame) -> DataFrame:
    """container, content: containers' bytes, made by tasks. slices: container, slice, ref, start, span, n, bases, first (number of the container's first record) and data (binary, one external block)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["slice"])
        made = [Slice(r["ref"], r["start"], r["span"], r["n"], ids=[1], blocks=[block(EXTERNAL, 1, r["data"])]) for r in rows]
        return pa.table({"container": [rows[0]["container"]], "content": [container(made, b"", min(r["first"] for r in rows), sum(r["bases"] for r in rows))]})

    return slices.groupBy("container").applyInArrow(run, "container long, content binary")


def parsed(containers: DataFrame) -> DataFrame:
    """container, slice, ref, start, span, n, counter, data of the slices in containers' bytes (container, content); data: the first data block."""
    names = ["container", "slice", "ref", "start", "span", "n", "counter", "data"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c, rows = content.as_py(), []
                _, own = cram._header(c, 3)
                for k, (mark, _, s) in enumerate(slices_of(c, 3)):
                    after = read_block(c, own + mark)[3]
                    rows.append((key, k, s.ref, s.start, s.span, s.n, s.counter, read_block(c, after)[2]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return containers.select("container", "content").mapInArrow(run, "container long, slice int, ref int, start int, span int, n long, counter long, data binary")
