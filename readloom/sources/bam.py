"""BAM: block-compressed binary records, decoded in Arrow batches.

A file is read by several tasks, each a range of its bytes. A task begins at the first block of its range, which
is known by its checksum, and there at the first record, which is known by a chain of records that hold
together; it takes all records that begin in the blocks of its range, so that each record is read once.
"""

from __future__ import annotations

import bisect
import itertools
import re
import struct
import zlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from readloom.functions.cigar import OPS
from readloom.sources import ranges

_BASES = "=ACMGRSVTWYHKDBN"
#: The two bases of a byte, and scores as letters.
_TWO = [a + b for a in _BASES for b in _BASES]
_SCORES = bytes(min(q + 33, 255) for q in range(256))
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,struct<type:string,value:string>>, rec_idx long"
_NUMBER = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def inflate(data: bytes) -> bytes:
    """The content of all blocks."""
    out, at = [], 0
    while at < len(data):
        size = struct.unpack_from("<H", data, at + 16)[0] + 1
        out.append(zlib.decompress(data[at + 18 : at + size - 8], -15))
        at += size
    return b"".join(out)


#: Bytes of content in a block that is written.
BLOCK = 65_000


def block(part: bytes) -> bytes:
    """One block of at most BLOCK bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(part) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))


def deflate(data: bytes, size: int = BLOCK, end: bytes = END) -> bytes:
    """data as blocks, with the mark of the end."""
    return b"".join([*(block(data[i : i + size]) for i in range(0, len(data), size)), end])


def _tag(data: bytes, at: int) -> tuple[str, str, str, int]:
    name, kind = data[at : at + 2].decode(), chr(data[at + 2])
    at += 3
    if kind == "A":
        return name, "A", chr(data[at]), at + 1
    if kind in "ZH":
        end = data.index(0, at)
        return name, kind, data[at:end].decode(), end + 1
    if kind == "B":
        sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
        size = struct.calcsize(_NUMBER[sub])
        values = [struct.unpack_from(_NUMBER[sub], data, at + 5 + i * size)[0] for i in range(n)]
        return name, "B", ",".join([sub, *map(str, values)]), at + 5 + n * size
    return name, kind, str(struct.unpack_from(_NUMBER[kind], data, at)[0]), at + struct.calcsize(_NUMBER[kind])


def header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, dictionary (name, length) and the place of the first record, of inflated data. The text's @SQ lines must agree with the dictionary."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    text, at = data[8 : 8 + n].rstrip(b"\0").decode(), 12 + n
    refs = []
    for _ in range(struct.unpack_from("<i", data, 8 + n)[0]):
        k = struct.unpack_from("<i", data, at)[0]
        refs.append((data[at + 4 : at + 3 + k].decode(), struct.unpack_from("<i", data, at + 4 + k)[0]))
        at += 8 + k
    named = [dict(f.split(":", 1) for f in x.split("\t")[1:]) for x in text.splitlines() if x.startswith("@SQ")]
    if named and [(x["SN"], int(x["LN"])) for x in named] != refs:
        raise ValueError("header text and dictionary differ")
    return text, refs, at


def _record(data, at: int, refs: list[tuple[str, int]]) -> tuple[tuple, int]:
    """The record at a place as a tuple in the order of SCHEMA, without rec_idx, and the place after it."""
    name = lambda i: "*" if i < 0 else refs[i][0]
    size, ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate, mpos, tlen = struct.unpack_from("<iiiBBHHHiiii", data, at)
    stop, p = at + 4 + size, at + 36
    qname = data[p : p + l_name - 1].decode()
    p += l_name
    ops = struct.unpack_from(f"<{n_ops}I", data, p)
    p += 4 * n_ops
    packed = data[p : p + (l_seq + 1) // 2]
    p += (l_seq + 1) // 2
    seq = "".join(map(_TWO.__getitem__, packed))[:l_seq]
    q = data[p : p + l_seq]
    p += l_seq
    tags = {}
    while p < stop:
        k, kind, v, p = _tag(data, p)
        tags[k] = {"type": kind, "value": v}
    return (
        qname, flag, name(ref), pos + 1, mapq, "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*", name(mate), mpos + 1, tlen,
        seq or "*", "*" if not l_seq or q[0] == 255 else q.translate(_SCORES).decode("latin-1"), list(tags.items()),
    ), stop


def records(data: bytes):
    """Records of inflated data, header included."""
    _, refs, at = header(data)
    while at < len(data):
        r, at = _record(data, at, refs)
        yield r


def _blocks(f, at: int, length: int):
    """(place in the file, content) of blocks from a block's place on. Pieces that are read grow from 64 KB, the most that a block has, to 1 MB."""
    size_read = 1 << 16
    while at < length:
        f.seek(at)
        buf, k = f.read(size_read), 0
        size_read = min(2 * size_read, 1 << 20)
        while k + 18 <= len(buf):
            if buf[k : k + 4] != b"\x1f\x8b\x08\x04" or buf[k + 12 : k + 14] != b"BC":
                raise ValueError(f"no block at {at + k}")
            size = struct.unpack_from("<H", buf, k + 16)[0] + 1
            if k + size > len(buf):
                break
            yield at + k, zlib.decompress(buf[k + 18 : k + size - 8], -15)
            k += size
        if not k:
            raise ValueError(f"the file ends within the block at {at}")
        at += k


def _first_block(f, begin: int, length: int) -> int | None:
    """The place of the first block from `begin` on: one whose checksum holds."""
    f.seek(begin)
    buf = f.read(min(length - begin, 2 << 16))  # a block has at most 2^16 bytes
    k = buf.find(b"\x1f\x8b\x08\x04")
    while k >= 0:
        if buf[k + 12 : k + 14] == b"BC" and k + 26 <= len(buf):
            size = struct.unpack_from("<H", buf, k + 16)[0] + 1
            try:
                part = zlib.decompress(buf[k + 18 : k + size - 8], -15)
                if k + size <= len(buf) and (zlib.crc32(part), len(part)) == struct.unpack_from("<II", buf, k + size - 8):
                    return begin + k
            except zlib.error:
                pass
        k = buf.find(b"\x1f\x8b\x08\x04", k + 1)
    return None


def _holds(data, at: int, n_refs: int) -> bool:
    """Whether a record can begin here, as far as the data go."""
    if len(data) - at < 36:
        return True
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, mate, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and mpos >= -1 and l_name and l_seq >= 0 and size >= 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq):
        return False
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return False
    ops = data[at + 36 + l_name : at + 36 + l_name + 4 * n_ops]
    return all(c & 15 <= 8 for c in ops[: len(ops) // 4 * 4 : 4])


def _first_record(f, block: int, length: int, n_refs: int, chain: int = 8) -> int | None:
    """The virtual place of the first record that begins at or after a block: from there on `chain` records hold together, or all up to the file's end do."""
    data, marks, at_end, blocks = bytearray(), [], False, _blocks(f, block, length)
    start, more = 0, 1 << 18
    while True:
        while len(data) < more and not at_end:
            got = next(blocks, None)
            at_end = got is None
            if got:
                marks.append((len(data), got[0]))
                data += got[1]
        while start < len(data):
            at = n = start
            n = 0
            while n < chain and at + 36 <= len(data) and _holds(data, at, n_refs):
                at += 4 + struct.unpack_from("<i", data, at)[0]
                n += 1
            if n == chain or (n and at_end and at == len(data)):
                k = bisect.bisect_right(marks, (start, 1 << 62)) - 1
                return marks[k][1] << 16 | start - marks[k][0]
            if not at_end and (at > len(data) - 36) and (n or len(data) - start < 36):
                break  # more data decide
            start += 1
        if at_end:
            return None
        more *= 2


def walk(f, begin: int, stop: int, length: int, refs: list[tuple[str, int]]):
    """(record, its virtual place, that of what follows it) from a virtual place to another one."""
    data, marks, blocks = bytearray(), [], _blocks(f, begin >> 16, length)

    def load() -> bool:
        got = next(blocks, None)
        if got:
            marks.append((len(data), got[0]))
            data.extend(got[1])
        return got is not None

    def place(at: int) -> int:
        while at >= len(data):
            if not load():
                return length << 16
        k = bisect.bisect_right(marks, (at, 1 << 62)) - 1
        return marks[k][1] << 16 | at - marks[k][0]

    at = begin & 0xFFFF
    here = place(at)
    while here < min(stop, length << 16):
        while len(data) < at + 4 or len(data) < at + 4 + struct.unpack_from("<i", data, at)[0]:
            if not load():
                raise ValueError("the file ends within a record")
        r, nxt = _record(data, at, refs)
        after = place(nxt)
        yield r, here, after
        at, here = nxt, after
        if at > 1 << 20:
            del data[:at]
            marks[:] = [(m - at, c) for m, c in marks if m - at > -(1 << 16)]
            at = 0


def _dictionary(f, length: int) -> tuple[list[tuple[str, int]], int]:
    """Contigs of a file, and the virtual place of its first record."""
    data, marks, enough = bytearray(), [], 0
    for at, part in _blocks(f, 0, length):
        marks.append((len(data), at))
        data += part
        if len(data) < enough:
            continue
        try:
            _, refs, stop = header(bytes(data))
        except (struct.error, IndexError, UnicodeDecodeError):
            enough = 2 * len(data)  # a header of many blocks isn't read anew at each
            continue
        if stop < len(data):
            k = bisect.bisect_right(marks, (stop, 1 << 62)) - 1
            return refs, marks[k][1] << 16 | stop - marks[k][0]
    _, refs, stop = header(bytes(data))
    if stop >= len(data):
        return refs, length << 16
    k = bisect.bisect_right(marks, (stop, 1 << 62)) - 1
    return refs, marks[k][1] << 16 | stop - marks[k][0]


def split_records(f, begin: int, stop: int, length: int):
    """(record, place, place after it) of the records that begin in the blocks of a range of bytes."""
    refs, first = _dictionary(f, length)
    if begin:
        block = _first_block(f, begin, length)
        if block is None or block >= stop:
            return
        at = first if first >> 16 >= block else _first_record(f, block, length, len(refs))
        if at is None:
            return
        first = at
    yield from walk(f, first, stop << 16, length, refs)


def header_bytes(refs: list[tuple[str, int]], text: str = "") -> bytes:
    """A header's content, not yet in blocks."""
    raw = text.encode()
    out = [b"BAM\1" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(refs))]
    for n, length in refs:
        out.append(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length))
    return b"".join(out)


def numbers(refs: list[tuple[str, int]]) -> dict[str, int]:
    return {n: i for i, (n, _) in enumerate(refs)} | {"*": -1}


_ELEMENT = re.compile(r"(\d+)([MIDNSHP=X])")
_NYBBLE = bytes(max(_BASES.find(chr(i).upper()), 0) if chr(i).upper() in _BASES else 15 for i in range(256))
_PHRED = bytes(max(i - 33, 0) for i in range(256))


def record_bytes(r, number: dict[str, int]) -> bytes:
    """A record (a dict by column of SCHEMA) as it stands in a file."""
    ops = [int(n) << 4 | OPS.index(o) for n, o in _ELEMENT.findall(r["cigar"])]
    seq = "" if r["seq"] == "*" else r["seq"]
    nyb = seq.encode("latin-1").translate(_NYBBLE) + b"\0" * (len(seq) % 2)
    tags = []
    for k, t in sorted((r.get("tags") or {}).items()):
        kind, v = t["type"], t["value"]
        if kind == "A":
            said = v.encode()
        elif kind in "ZH":
            said = v.encode() + b"\0"
        elif kind == "B":
            sub, *items = v.split(",")
            said = sub.encode() + struct.pack("<i", len(items)) + b"".join(struct.pack(_NUMBER[sub], float(x) if sub == "f" else int(x)) for x in items)
        else:
            said = struct.pack(_NUMBER[kind], float(v) if kind == "f" else int(v))
        tags.append(k.encode() + kind.encode() + said)
    tags = b"".join(tags)
    span = sum(o >> 4 for o in ops if OPS[o & 15] in "MDN=X") or 1
    body = struct.pack("<iiBBHHHiiii", number[r["rname"]], r["pos"] - 1, len(r["qname"]) + 1, r["mapq"], _bin(r["pos"] - 1, r["pos"] - 1 + span), len(ops), r["flag"], len(seq), number[r.get("rnext") or "*"], (r.get("pnext") or 0) - 1, r.get("tlen") or 0)
    body += r["qname"].encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(nyb[::2], nyb[1::2], strict=True))
    body += b"\xff" * len(seq) if r["qual"] == "*" else r["qual"].encode("latin-1").translate(_PHRED)
    return struct.pack("<i", len(body) + len(tags)) + body + tags


def encode(reads, refs: list[tuple[str, int]], text: str = "") -> bytes:
    """A BAM file of records (dicts by column of SCHEMA)."""
    number = numbers(refs)
    return deflate(b"".join([header_bytes(refs, text), *(record_bytes(r, number) for r in reads)]))


def _bin(begin: int, end: int) -> int:
    if begin < 0:
        return 4680
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == (end - 1) >> shift:
            return first + (begin >> shift)
    return 0


def _rows(places: DataFrame, find: Callable, opener: Callable, batch: int, offsets: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = SCHEMA + (", voffset long, vend long" if offsets else "")
    to = to_arrow_schema(StructType.fromDDL(schema))

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), to, strict=True)], schema=to)

    def run(batches):
        for b in batches:
            for part, path, begin, stop, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, n = [], 0
                with opener(path) as f:
                    for r, here, after in find(f, begin, stop, length):
                        rows.append((*r, (part << 33) + n, here, after) if offsets else (*r, (part << 33) + n))
                        n += 1
                        if len(rows) == batch:
                            yield packed(rows)
                            rows = []
                if rows:
                    yield packed(rows)

    return places.mapInArrow(run, schema)


def read_bam(spark: SparkSession, path: str, batch: int = 10_000, split: int = ranges.SPLIT, offsets: bool = False, opener: Callable = ranges.opened) -> DataFrame:
    """Records of BAM files, a task for each `split` bytes. rec_idx rises in file order (text.dense_numbers makes it dense). offsets: with the virtual places of each record and of what follows it."""
    return _rows(ranges.splits(spark, path, split), split_records, opener, batch, offsets)


def read_places(spark: SparkSession, places: list[tuple[str, int, int, int]], batch: int = 10_000, opener: Callable = ranges.opened) -> DataFrame:
    """Records between virtual places (path, begin, stop, the file's bytes), which an index gives."""

    def find(f, begin, stop, length):
        return walk(f, begin, stop, length, _dictionary(f, length)[0])

    return _rows(ranges.tasks(spark, places), find, opener, batch, False)


def _dicts(b: pa.RecordBatch):
    """Records as dicts by column; columns become lists as a whole, tags from their keys, types and values."""
    m = b.column("tags")
    at, keys = m.offsets.to_pylist(), m.keys.to_pylist()
    said = [{"type": t, "value": v} for t, v in zip(m.items.field("type").to_pylist(), m.items.field("value").to_pylist(), strict=True)]
    tags = (dict(zip(keys[i:k], said[i:k], strict=True)) for i, k in itertools.pairwise(at))
    names = [n for n in b.schema.names if n != "tags"]
    for t, *r in zip(tags, *(b.column(n).to_pylist() for n in names), strict=True):
        yield dict(zip(names, r, strict=True)) | {"tags": t}


#: Records of one file of to_bam(), which a task holds, where parts are made from a number of records.
RECORDS = 250_000


def to_bam(reads: DataFrame, refs: list[tuple[str, int]], text: str = "", parts: int | None = None, order: Sequence[Column | str] = ("rec_idx",)) -> DataFrame:
    """part, content: the records as whole BAM files, one for each range of rec_idx or of another order; rows can be written to any store, for example by foreachPartition. Records are shuffled once, into that order."""
    ranged = (reads.repartitionByRange(parts, *order) if parts else reads.repartitionByRange(*order)).sortWithinPartitions(*order)
    ranged = ranged.select(*(c for c in reads.columns if c in StructType.fromDDL(SCHEMA).names))  # what a file doesn't hold isn't shuffled

    def run(batches):
        from pyspark import TaskContext

        rows = (r for b in batches for r in _dicts(b))
        first = next(rows, None)
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([encode(itertools.chain([first], rows), refs, text)], pa.binary())], names=["part", "content"])

    return ranged.mapInArrow(run, "part int, content binary")
