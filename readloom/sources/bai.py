"""BAI: the binning index of a sorted BAM file, built by tasks over ranges of the file, read, and used.

Index rows (`INDEX`) are the common form: kind `chunk` (key: the bin; begin and stop: virtual places), `line`
(key: the 16 kb window; begin: the least place of a record that overlaps it), `span` (places of a
contig's records), `count` (begin: mapped, stop: unmapped records) and `loose` (begin: records without a place).
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import cigar
from readloom.sources import bam, ranges

INDEX = "path string, kind string, ref int, key int, begin long, stop long"
#: The bin that holds a contig's counts (fixed value of the format).
COUNTS = 37450


def merged(chunks: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Chunks in order; one that begins in the block where the one before ends, or earlier, becomes part of it."""
    out: list[list[int]] = []
    for b, e in sorted(chunks):
        if out and b >> 16 <= out[-1][1] >> 16:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


def of_records(records, refs: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """Index rows without path of (record, place, place after it) in file order."""
    chunks: dict[tuple[int, int], list[list[int]]] = {}
    lines: dict[tuple[int, int], int] = {}
    spans: dict[int, list[int]] = {}
    loose = 0
    for r, here, after in records:
        flag, name, pos, text = r[1], r[2], r[3], r[5]
        if name == "*" or pos < 1:
            loose += 1
            continue
        ref, begin = refs[name], pos - 1
        end = begin + (sum(map(int, re.findall(r"(\d+)[MDN=X]", text))) if not flag & 4 else 0)
        end = max(end, begin + 1)
        held = chunks.setdefault((ref, bam._bin(begin, end)), [])
        if held and here >> 16 <= held[-1][1] >> 16:
            held[-1][1] = after
        else:
            held.append([here, after])
        for w in range(begin >> 14, (end - 1 >> 14) + 1):
            lines.setdefault((ref, w), here)
        s = spans.setdefault(ref, [here, after, 0, 0])
        s[1] = after
        s[3 if flag & 4 else 2] += 1
    out = [("chunk", ref, b, *c) for (ref, b), held in chunks.items() for c in held]
    out += [("line", ref, w, at, 0) for (ref, w), at in lines.items()]
    for ref, (a, b, mapped, not_mapped) in spans.items():
        out += [("span", ref, 0, a, b), ("count", ref, 0, mapped, not_mapped)]
    return [*out, ("loose", -1, 0, loose, 0)]


def _batch(path: str, rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[path] * len(rows), *zip(*rows, strict=True)], kinds, strict=True)], names=["path", "kind", "ref", "key", "begin", "stop"])


def _of_range(f, begin: int, stop: int, length: int) -> list[tuple]:
    refs, _ = bam._dictionary(f, length)
    rows = of_records(bam.split_records(f, begin, stop, length), {n: i for i, (n, _) in enumerate(refs)})
    return rows if begin else [*rows, ("refs", -1, 0, len(refs), 0)]


def index_rows(spark: SparkSession, path: str, split: int = ranges.SPLIT, opener: Callable = ranges.opened) -> DataFrame:
    """Index rows of sorted BAM files, gathered within each range of a file: few rows for many records. A row `refs` tells the number of contigs."""
    def run(batches):
        for batch in batches:
            for _, p, begin, stop, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opener(p) as f:
                    yield _batch(p, _of_range(f, begin, stop, length))

    return ranges.splits(spark, path, split).mapInArrow(run, INDEX)


def index_rows_of(files: DataFrame) -> DataFrame:
    """Index rows of whole sorted BAM files, given as path and content."""

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield _batch(p, _of_range(io.BytesIO(content), 0, len(content), len(content)))

    return files.select("path", "content").mapInArrow(run, INDEX)


def section(rows: Iterable[tuple[str, int, int, int]]) -> bytes:
    """The bytes of one contig, of rows (kind, key, begin, stop)."""
    bins: dict[int, list] = {}
    lines: dict[int, int] = {}
    span, counts = [], [0, 0]
    for kind, key, b, e in rows:
        if kind == "chunk":
            bins.setdefault(key, []).append((b, e))
        elif kind == "line":
            lines[key] = min(b, lines.get(key, b))
        elif kind == "span":
            span += [b, e]
        else:
            counts = [counts[0] + b, counts[1] + e]
    out = [struct.pack("<i", len(bins) + bool(span))]
    for k in sorted(bins):
        held = merged(bins[k])
        out.append(struct.pack("<Ii", k, len(held)) + b"".join(struct.pack("<QQ", *c) for c in held))
    if span:
        out.append(struct.pack("<Ii4Q", COUNTS, 2, min(span), max(span), *counts))
    top, last = max(lines, default=-1) + 1, 0
    out.append(struct.pack("<i", top))
    for w in range(top):  # an empty window has the place of the one before
        last = lines.get(w, last)
        out.append(struct.pack("<Q", last))
    return b"".join(out)


def to_bai(rows: DataFrame) -> DataFrame:
    """path, content: the BAI file of each BAM file, of its index rows, which are met once. A task holds one contig's index (at most 37,450 bins), then one file's."""

    def contig(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["ref"].iloc[0] < 0:
            return pd.DataFrame({"path": [pdf["path"].iloc[0]], "ref": [int(pdf["ref"].iloc[0])], "content": [None], "n": [int(pdf["begin"].sum())]})
        it = zip(pdf["kind"], pdf["key"].tolist(), pdf["begin"].tolist(), pdf["stop"].tolist(), strict=True)
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "ref": [int(pdf["ref"].iloc[0])], "content": [section(it)], "n": [0]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.loc[pdf["ref"] == -2, "n"].sum())
        loose = int(pdf.loc[pdf["ref"] == -1, "n"].sum())
        parts = dict(zip(pdf["ref"].tolist(), pdf["content"], strict=True))
        body = b"".join(bytes(parts[i]) if i in parts else bytes(8) for i in range(n))
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [b"BAI\1" + struct.pack("<i", n) + body + struct.pack("<Q", loose)]})

    rows = rows.withColumn("ref", F.expr("if(ref >= 0, ref, if(kind = 'refs', -2, -1))"))
    sections = rows.groupBy("path", "ref").applyInPandas(contig, "path string, ref int, content binary, n long")
    return sections.groupBy("path").applyInPandas(whole, "path string, content binary")


def parse(data: bytes) -> list[tuple[str, int, int, int, int]]:
    """Index rows without path of a BAI file; a file that is cut off or isn't BAI is an error."""
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAI file")
    n, at, out = struct.unpack_from("<i", data, 4)[0], 8, []
    for ref in range(n):
        bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(bins):
            b, k = struct.unpack_from("<Ii", data, at)
            places = struct.unpack_from(f"<{2 * k}Q", data, at + 8)
            at += 8 + 16 * k
            if b == COUNTS:
                out += [("span", ref, 0, *places[:2]), ("count", ref, 0, *places[2:4])]
            else:
                out += [("chunk", ref, b, *places[i : i + 2]) for i in range(0, 2 * k, 2)]
        k = struct.unpack_from("<i", data, at)[0]
        out += [("line", ref, w, x, 0) for w, x in enumerate(struct.unpack_from(f"<{k}Q", data, at + 4))]
        at += 4 + 8 * k
    if at + 8 <= len(data):  # the last number is optional
        out.append(("loose", -1, 0, struct.unpack_from("<Q", data, at)[0], 0))
    return [*out, ("refs", -1, 0, n, 0)]


def parsed(files: DataFrame) -> DataFrame:
    """Index rows of BAI files, given as path and content."""

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield _batch(p, parse(content))

    return files.select("path", "content").mapInArrow(run, INDEX)


def read_bai(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of BAI files; path is the index's own."""
    return parsed(spark.read.format("binaryFile").load(path))


def bins_of(start: int, stop: int) -> list[int]:
    """All bins that can hold records overlapping start .. stop (1-based, both included)."""
    b, e = start - 1, stop - 1
    return [0] + [k for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)) for k in range(first + (b >> shift), first + (e >> shift) + 1)]


def places(index: DataFrame, ref: int, start: int, stop: int) -> list[list[int]]:
    """Stretches of the file (virtual places) that can hold records overlapping start .. stop of a contig: chunks of the region's bins (at most 37,449), without what lies before the first record that overlaps its first window."""
    own = index.where(F.col("ref") == ref)
    found = own.where((F.col("kind") == "chunk") & F.col("key").isin(bins_of(start, min(stop, 1 << 29)))).select("begin", "stop").collect()
    least = own.where((F.col("kind") == "line") & (F.col("key") <= start - 1 >> 14)).agg(F.max_by("begin", "key")).collect()[0][0] or 0
    return merged((max(b, least), e) for b, e in found if e > least)


def read_region(spark: SparkSession, path: str, index_path: str, rname: str, start: int, stop: int, opener: Callable = ranges.opened) -> DataFrame:
    """Records of a BAM file that overlap a region; only the blocks that its index names are read. A contig that the file doesn't have is an error."""
    (name, length) = ranges.files(spark, path)[0]
    with opener(name) as f:
        refs = [n for n, _ in bam._dictionary(f, length)[0]]
    spots = [(name, b, e, length) for b, e in places(read_bai(spark, index_path), refs.index(rname), start, stop)]
    got = bam.read_places(spark, spots, opener=opener).where((F.col("rname") == rname) & (F.col("pos") <= stop))
    last = F.when((F.col("flag").bitwiseAND(4) != 0) | (F.col("cigar") == "*"), F.col("pos")).otherwise(F.greatest("pos", cigar.alignment_end(F.col("pos"), F.col("cigar"))))
    return got.where(last >= start)
