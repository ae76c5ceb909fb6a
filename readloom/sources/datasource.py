"""BAM files and CRAM containers as Spark data sources: `readloom-bam` and `readloom-cram`.

    datasource.register(spark)
    spark.read.format("readloom-bam").load(path).where("rname = 'chr1' and pos between 1000 and 2000")
    sorted_reads.write.format("readloom-bam").option("header", text).option("refs", json).mode("overwrite").save(path)

Reading: a partition is a range of a file's bytes. Filters on contig and position are pushed: where an index lies beside a file (`x.bam.bai` or
`x.bai`) only the stretches that it names are read, and a contig of the header's that isn't asked for takes nothing. Spark tests the filters again, so what is pushed
only saves reading. For CRAM the containers' headers decide which contents are read.

Writing: each task writes its records to a file of its own, block by block, so it holds one block however many records there are. Only when all have ended does the
commit put files in place: by default each is a whole BAM file; with the option `single` the bodies are copied, as they are, behind one
header into one file. If a task fails nothing is left.

Options: `path` (a file, a folder, or a pattern of names in a folder), `files` (JSON of [path, bytes], in place of a listing), `split` (bytes of a partition),
`opener` (`module:function` of a path; without it Arrow's file systems). Filters are pushed where spark.sql.python.filterPushdown.enabled is set;
`region` (`chr1:1000-2000`) does the same as an option.
"""

from __future__ import annotations

import fnmatch
import importlib
import json
import struct
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from readloom.sources import bai, bam, cram, ranges

LAST = (1 << 31) - 1
COPY = 8 << 20


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, with filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    spark.dataSource.register(CramSource)


def _system(path: str):
    """Arrow's file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder or pattern that have an ending, by path."""
    from pyarrow import fs

    folder, _, name = path.rstrip("/").rpartition("/")
    place = folder if "*" in name else path.rstrip("/")
    system, inner = _system(place)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)]
    lead = "" if isinstance(system, fs.LocalFileSystem) else place[: place.find(inner)]
    want = name if "*" in name else f"*{ending}"
    return sorted((lead + f.path, f.size) for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and fnmatch.fnmatch(f.base_name, want))


def _opener(options):
    if "opener" not in options:
        return ranges.opened
    module, name = options["opener"].split(":")
    return getattr(importlib.import_module(module), name)


@dataclass
class Range(InputPartition):
    """Records between two virtual places of a file (or of the blocks of a range of bytes), numbered from `first` on."""

    path: str
    begin: int
    stop: int
    length: int
    virtual: bool
    first: int


class _Wanted:
    """What the pushed filters leave: a contig, and the least and the greatest position."""

    def __init__(self, options):
        self.rname, self.low, self.high, self.overlap = None, -LAST, LAST, False
        if "region" in options:
            self.rname, _, span = options["region"].partition(":")
            self.overlap = True
            if span:
                low, _, high = span.partition("-")
                self.low, self.high = int(low), int(high or LAST)

    def push(self, f, name: str, column: str) -> None:
        if self.overlap or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            return
        if isinstance(f, EqualTo) and f.attribute == (name,):
            self.rname = f.value
        if f.attribute != (column,) or not isinstance(f.value, int):
            return
        if isinstance(f, EqualTo):
            self.low, self.high = max(self.low, f.value), min(self.high, f.value)
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value - isinstance(f, LessThan))


def _content(opener, path: str) -> bytes | None:
    try:
        with opener(path) as f:
            return f.read()
    except (FileNotFoundError, OSError):
        return None


class BamReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.schema, self.wanted = dict(options), schema, _Wanted(options)
        self.opener, self.split = _opener(options), int(options.get("split", ranges.SPLIT))

    def pushFilters(self, filters):
        for f in filters:
            self.wanted.push(f, "rname", "pos")
            yield f  # places are found by blocks, so each record is tested again

    def partitions(self):
        files = json.loads(self.options["files"]) if "files" in self.options else listed(self.options["path"], ".bam")
        out: list[Range] = []
        for path, length in files:
            for begin, stop, virtual in self._stretches(path, length):
                out.append(Range(path, begin, stop, length, virtual, len(out) << 33))
        return out or [Range("", 0, 0, 0, True, 0)]

    def _stretches(self, path: str, length: int):
        """Ranges of bytes; with an index, the stretches that can hold what is wanted, cut at `split` bytes."""
        w = self.wanted
        index = w.rname is not None and (_content(self.opener, f"{path}.bai") or _content(self.opener, path.removesuffix(".bam") + ".bai"))
        if not index:
            return [(at, min(at + self.split, length), False) for at in range(0, length, self.split)]
        with self.opener(path) as f:
            names = [n for n, _ in bam._dictionary(f, length)[0]]
        if w.rname not in names:
            return [] if w.rname != "*" else [(at, min(at + self.split, length), False) for at in range(0, length, self.split)]
        low, high = max(w.low, 1), min(w.high, 1 << 29)
        if low > high:
            return []
        rows = [r for r in bai.parse(index) if r[1] == names.index(w.rname)]
        bins = set(bai.bins_of(low, high))
        least = max((b for kind, _, key, b, _ in rows if kind == "line" and key <= low - 1 >> 14), default=0)
        found = bai.merged((max(b, least), e) for kind, _, key, b, e in rows if kind == "chunk" and key in bins and e > least)
        out = []
        for b, e in found:  # a long stretch is cut at blocks that the windows of the contig begin in
            cuts = sorted({b} | {at for kind, _, _, at, _ in rows if kind == "line" and b < at < e})
            last = b
            for c in [*cuts[1:], e]:
                if (c >> 16) - (last >> 16) >= self.split or c == e:
                    out.append((last, c, True))
                    last = c
        return out

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        to = to_arrow_schema(self.schema)
        w, rows, n = self.wanted, [], 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), to, strict=True)], schema=to)

        with self.opener(partition.path) as f:
            if partition.virtual:
                found = bam.walk(f, partition.begin, partition.stop, partition.length, bam._dictionary(f, partition.length)[0])
            else:
                found = bam.split_records(f, partition.begin, partition.stop, partition.length)
            for r, _, _ in found:
                n += 1  # numbers rise in the order of files and of places
                if w.rname is not None and r[2] != w.rname or r[3] > w.high or (w.overlap and _last(r) < w.low):
                    continue
                rows.append((*r, partition.first + n - 1))
                if len(rows) == 4096:
                    yield packed()
                    rows = []
        if rows:
            yield packed()


def _last(r) -> int:
    """The last position of a record."""
    span = sum(int(n) for n, o in bam._ELEMENT.findall(r[5]) if o in "MDN=X") if not r[1] & 4 else 0
    return r[3] + max(span, 1) - 1


@dataclass
class Part(WriterCommitMessage):
    part: int
    path: str
    records: int
    size: int


class Blocks:
    """Bytes put into a file block by block."""

    def __init__(self, sink):
        self.sink, self.held, self.size, self.written, self.most = sink, [], 0, 0, 0

    def add(self, data: bytes) -> None:
        self.held.append(data)
        self.size += len(data)
        self.most = max(self.most, self.size)
        if self.size >= bam.BLOCK:
            self._put(False)

    def _put(self, all_of_it: bool) -> None:
        data, at = b"".join(self.held), 0
        while len(data) - at >= bam.BLOCK or (all_of_it and at < len(data)):
            out = bam.block(data[at : at + bam.BLOCK])
            self.sink.write(out)
            self.written += len(out)
            at += bam.BLOCK
        self.held, self.size = [data[at:]], max(0, len(data) - at)

    def end(self) -> None:
        self._put(True)


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.text, self.single = options["path"].rstrip("/"), options.get("header", ""), options.get("single", "false").lower() == "true"
        self.refs = [tuple(x) for x in json.loads(options["refs"])]
        self.aside, self.overwrite = f"{self.path}.writing-{uuid.uuid4().hex}", overwrite

    def _start(self) -> bytes:
        return bam.deflate(bam.header_bytes(self.refs, self.text), end=b"")

    def write(self, iterator):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path, number, n = f"{self.aside}/{part:08d}-{TaskContext.get().taskAttemptId()}", bam.numbers(self.refs), 0
        system, inner = _system(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner) as sink:
            if not self.single:
                sink.write(self._start())
            blocks = Blocks(sink)
            for batch in iterator:
                for at in range(0, batch.num_rows, 512):
                    for r in batch.slice(at, 512).to_pylist():
                        blocks.add(bam.record_bytes(r | {"tags": dict(r.get("tags") or {})}, number))
                        n += 1
            blocks.end()
            if not self.single:
                sink.write(bam.END)
        return Part(part, path, n, blocks.written)

    def commit(self, messages):
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        system, inner = _system(self.path)
        if self.single:
            system.create_dir(inner.rpartition("/")[0], recursive=True)
            with system.open_output_stream(f"{inner}.joining") as out:
                out.write(self._start())
                for m in done:
                    _copy(m.path, out)
                out.write(bam.END)
            system.move(f"{inner}.joining", inner)
        else:
            from pyarrow import fs

            if self.overwrite and system.get_file_info(inner).type != fs.FileType.NotFound:
                for f in system.get_file_info(fs.FileSelector(inner)):
                    if f.is_file and f.base_name.startswith("part-"):
                        system.delete_file(f.path)
            system.create_dir(inner, recursive=True)
            for m in done:
                if m.records or m.part == done[0].part:
                    system.move(_system(m.path)[1], f"{inner}/part-{m.part:08d}.bam")
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        from pyarrow import fs

        system, inner = _system(self.aside)
        if system.get_file_info(inner).type != fs.FileType.NotFound:
            system.delete_dir(inner)


def _copy(path: str, out, begin: int = 0) -> None:
    """A file's bytes as they are, piece by piece."""
    system, inner = _system(path)
    with system.open_input_stream(inner) as f:
        left = begin
        while left and (x := f.read(min(left, COPY))):
            left -= len(x)
        while x := f.read(COPY):
            out.write(x)


class BamSource(DataSource):
    """Records of BAM files."""

    @classmethod
    def name(cls):
        return "readloom-bam"

    def schema(self):
        return bam.SCHEMA

    def reader(self, schema):
        return BamReader(self.options, schema)

    def writer(self, schema, overwrite):
        return BamWriter(self.options, overwrite)


def put(files) -> int:
    """Write files (path, content) by tasks, each aside first and then moved into place; returns how many."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                system, inner = _system(path)
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                aside = f"{inner}.{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as out:
                    out.write(content.as_py())
                system.move(aside, inner)
                yield pa.RecordBatch.from_pydict({"path": [path]})

    return files.select("path", "content").mapInArrow(run, "path string").count()


def write_indexes(indexes) -> int:
    """Put indexes (path, content) beside their files, as `path.bai`; returns how many."""
    from pyspark.sql import functions as F

    return put(indexes.select(F.concat("path", F.lit(".bai")).alias("path"), "content"))


def with_header(data: bytes, length: int, first: int, text: str, refs: list[tuple[str, int]]) -> tuple[bytes, int]:
    """New first blocks of a file, and the place from which its own bytes follow as they are. data: the file's bytes up to the block after the one with the first record; first: that record's virtual place.

    Records that share a block with the old header come again in a block of their own.
    """
    at, rest, place = first >> 16, b"", first >> 16
    if at < length:
        size = struct.unpack_from("<H", data, at + 16)[0] + 1
        if first & 0xFFFF:
            rest, place = bam.inflate(data[at : at + size])[first & 0xFFFF :], at + size
    return bam.deflate(bam.header_bytes(refs, text), end=b"") + (bam.deflate(rest, end=b"") if rest else b""), place


def replace_header(spark: SparkSession, path: str, folder: str, edit, parts: int = 200):
    """Write BAM files anew to a folder with another header text, a task for each file: only the header's blocks are made again, all later ones are copied as they are. edit: a function of the old text; contigs stay.

    Returns path, written, copied (bytes that were copied as they are).
    """

    def run(batches):
        for b in batches:
            for path, length in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
                with ranges.opened(path) as f:
                    refs, first = bam._dictionary(f, length)
                    f.seek(0)
                    data = f.read(min(length, (first >> 16) + (1 << 16)))
                text = bam.header(bam.inflate(_whole_blocks(data)))[0]
                start, place = with_header(data, length, first, edit(text), refs)
                system, inner = _system(f"{folder}/{path.rpartition('/')[2]}")
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                aside = f"{inner}.{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as out:
                    out.write(start)
                    _copy(path, out, place)
                system.move(aside, inner)
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rpartition('/')[2]}"], "written": [len(start)], "copied": [length - place]})

    files = ranges.files(spark, path)
    return ranges.tasks(spark, [(p, 0, n, n) for p, n in files]).mapInArrow(run, "path string, written long, copied long")


def _whole_blocks(data: bytes) -> bytes:
    at = 0
    while at + 18 <= len(data) and at + struct.unpack_from("<H", data, at + 16)[0] + 1 <= len(data):
        at += struct.unpack_from("<H", data, at + 16)[0] + 1
    return data[:at]


@dataclass
class Containers(InputPartition):
    path: str
    length: int


class CramReader(DataSourceReader):
    """A file's containers: the headers are walked, and a content is read only if the pushed filters leave its container."""

    def __init__(self, options, schema):
        self.options, self.schema, self.wanted, self.ref = dict(options), schema, _Wanted({}), None
        self.opener = _opener(options)

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ref",):
                self.ref = f.value
            self.wanted.push(f, "", "start")
            yield f

    def partitions(self):
        files = json.loads(self.options["files"]) if "files" in self.options else listed(self.options["path"], ".cram")
        return [Containers(p, n) for p, n in files]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(self.schema)
        with self.opener(partition.path) as f, self.opener(partition.path) as g:
            for k, c in enumerate(cram.walk(f, partition.length)):
                at, size, ref, start = c[:4]
                if self.ref is not None and ref != self.ref or not self.wanted.low <= start <= self.wanted.high:
                    continue
                g.seek(at)
                row = (partition.path, k, *c, g.read(size))
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, to, strict=True)], schema=to)


class CramSource(DataSource):
    """Containers of CRAM files with their bytes."""

    @classmethod
    def name(cls):
        return "readloom-cram"

    def schema(self):
        return f"{cram.CONTAINERS}, content binary"

    def reader(self, schema):
        return CramReader(self.options, schema)
