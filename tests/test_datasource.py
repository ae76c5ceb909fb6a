"""BAM and CRAM as data sources: what is read, what is written, and how much."""

from __future__ import annotations

import json
import os
import struct

import pytest

from readloom.plans.fixtures import reads
from readloom.sources import bai, bam, cram, datasource, ranges

SF = "/root/testdata/sf0.001"
REFS = [("chr1", 3_000_000), ("chr2", 3_000_000)]


class _Counted:
    def __init__(self, path):
        self.f, self.path, self.n = open(path, "rb"), path, 0

    def read(self, n=-1):
        b = self.f.read(n)
        self.n += len(b)
        return b

    def seek(self, *at):
        return self.f.seek(*at)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()
        with open(f"{self.path}.reads", "a") as out:
            out.write(f"{self.n}\n")


def counting(path):
    """An opener that notes beside the file how much of it was read."""
    return _Counted(path.removeprefix("file:"))


def _bytes_read(path):
    with open(f"{path}.reads") as f:
        n = sum(map(int, f))
    os.remove(f"{path}.reads")
    return n


def _rows(n, step=300):
    import random

    rng = random.Random(3)
    return [
        (f"q{k}", 0, REFS[k * 2 // n][0], 1 + k % (n // 2) * step, 60, "50M", "*", 0, 0, "".join(rng.choices("ACGT", k=50)), "".join(rng.choices("ABCDEFGHI", k=50)), {"RG": ("Z", "a"), "NM": ("c", str(k % 5))}, k)
        for k in range(n)
    ]


def _table(spark, n, parts=3):
    return spark.createDataFrame(_rows(n), bam.SCHEMA).repartitionByRange(parts, "rec_idx").sortWithinPartitions("rec_idx")


def _write(df, path, **options):
    datasource.register(df.sparkSession)
    w = df.write.format("readloom-bam").option("refs", json.dumps(REFS)).option("header", "@HD\tVN:1.6\n")
    for k, v in options.items():
        w = w.option(k, v)
    w.mode("overwrite").save(str(path))


def test_one_file_is_written_by_several_tasks(spark, tmp_path):
    path = tmp_path / "all.bam"
    _write(_table(spark, 6000), path, single="true")
    data = path.read_bytes()
    assert data.endswith(bam.END) and data.count(bam.END) == 1 and os.listdir(tmp_path) == ["all.bam"]
    got = list(bam.records(bam.inflate(data)))
    assert [r[:11] for r in got] == [r[:11] for r in _rows(6000)] and dict(got[7][11])["NM"] == {"type": "c", "value": "2"}
    back = spark.read.format("readloom-bam").option("split", 60_000).load(str(path))
    assert back.rdd.getNumPartitions() > 5
    assert [r.qname for r in back.orderBy("rec_idx").collect()] == [f"q{k}" for k in range(6000)]


def test_files_of_a_folder_are_whole_files(spark, tmp_path):
    _write(_table(spark, 900), tmp_path / "out")
    _write(_table(spark, 600, 2), tmp_path / "out")  # written over
    names = sorted(os.listdir(tmp_path / "out"))
    assert names == ["part-00000000.bam", "part-00000001.bam"]
    for n in names:
        data = (tmp_path / "out" / n).read_bytes()
        assert data.endswith(bam.END) and bam.header(bam.inflate(data))[0].startswith("@HD")
    assert spark.read.format("readloom-bam").load(str(tmp_path / "out")).count() == 600
    assert spark.read.format("readloom-bam").load(str(tmp_path / "out" / "*1.bam")).count() == 300
    with pytest.raises(Exception, match="FileNotFound|nothing"):
        spark.read.format("readloom-bam").load(str(tmp_path / "nothing")).count()


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    bad = _table(spark, 300).selectExpr("*").withColumn("rname", __import__("pyspark.sql.functions", fromlist=["expr"]).expr("if(rec_idx = 299, 'chrX', rname)"))
    with pytest.raises(Exception):  # noqa: B017
        _write(bad, tmp_path / "bad")
    assert os.listdir(tmp_path) == []


def test_an_empty_table_is_a_whole_file(spark, tmp_path):
    _write(spark.createDataFrame([], bam.SCHEMA), tmp_path / "none.bam", single="true")
    assert spark.read.format("readloom-bam").load(str(tmp_path / "none.bam")).collect() == []


def test_a_writer_holds_one_block():
    class Sink:
        n = 0

        def write(self, b):
            self.n += len(b)

    most = []
    for n in (2_000, 40_000):
        b = datasource.Blocks(Sink())
        for _ in range(n):
            b.add(os.urandom(100))
        b.end()
        most.append(b.most)
        assert b.sink.n == b.written > 90 * n
    assert max(most) < bam.BLOCK + 200


def test_filters_choose_the_stretches_that_are_read(spark, tmp_path):
    path = str(tmp_path / "big.bam")
    _write(_table(spark, 20_000, 1), path, single="true")
    source = lambda: spark.read.format("readloom-bam").option("opener", "tests.test_datasource:counting")
    read = lambda: source().load(path)
    near = "rname = 'chr2' and pos > 1500000 and pos <= 1530000"
    want = {r[0] for r in _rows(20_000) if r[2] == "chr2" and 1_500_000 < r[3] <= 1_530_000}
    assert {r.qname for r in read().where(near).collect()} == want
    whole = _bytes_read(path)
    assert datasource.write_indexes(bai.to_bai(bai.index_rows(spark, path))) == 1
    assert {r.qname for r in read().where(near).collect()} == want and len(want) == 100
    assert _bytes_read(path) < whole / 3
    assert {r.qname for r in source().option("region", "chr2:1500002-1500300").load(path).collect()} == {r[0] for r in _rows(20_000) if r[2] == "chr2" and r[3] <= 1_500_300 and r[3] + 49 >= 1_500_002}
    assert read().where("rname = 'chr9'").count() == 0 and read().where("rname = 'chr1'").count() == 10_000
    assert read().where("rname = 'chr1' and pos > 5 and pos < 5").count() == 0 and read().where("rname = 'chr1' or pos = 1").count() == 10_001


def test_header_is_replaced_and_blocks_stay(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _write(_table(spark, 5000, 2), src / "a.bam", single="true")
    # a file whose first records share the header's block
    (src / "b.bam").write_bytes(bam.encode([dict(zip([f.split()[0] for f in bam.SCHEMA.split(", ")], r)) | {"tags": {}} for r in _rows(3000)], REFS, "@HD\tVN:1.5\n"))
    (src / "c.bam").write_bytes(bam.encode([], REFS, "@HD\tVN:1.5\n"))
    out = str(tmp_path / "out")
    said = {r.path.rpartition("/")[2]: r for r in datasource.replace_header(spark, str(src), out, lambda t: t + "@CO\t" + "new " * 40_000 + "\n").collect()}
    for n in "abc":
        old, new = (src / f"{n}.bam").read_bytes(), (tmp_path / "out" / f"{n}.bam").read_bytes()
        assert said[f"{n}.bam"].copied >= (0 if n == "c" else len(old) // 2) and new.endswith(old[len(old) - said[f"{n}.bam"].copied :])
        assert list(bam.records(bam.inflate(new))) == list(bam.records(bam.inflate(old)))
        text = bam.header(bam.inflate(new))[0]
        assert text.endswith("new \n") and text.startswith("@HD")
    assert said["a.bam"].copied > 100_000


def _cram(path, containers):
    """A file of version 3 of containers (ref, start, span, n, content)."""
    import zlib

    out = [b"CRAM\3\0" + b"\0" * 20]
    for ref, start, span, n, content in [(0, 0, 0, 0, b"head"), *containers]:
        h = struct.pack("<i", len(content)) + b"".join(map(_itf8, (ref, start, span, n))) + b"\0\0" + _itf8(1) + _itf8(1) + _itf8(0)
        out.append(h + struct.pack("<I", zlib.crc32(h)) + content)
    path.write_bytes(b"".join(out) + bytes.fromhex(cram.ENDS[3]))


def _itf8(x):
    x &= 0xFFFFFFFF
    if x < 0x80:
        return bytes([x])
    return bytes([0xF0 | x >> 28, x >> 20 & 255, x >> 12 & 255, x >> 4 & 255, x & 15])


def test_cram_containers_by_filter(spark, tmp_path):
    path = tmp_path / "x.cram"
    _cram(path, [(i // 4, 1 + 1000 * (i % 4), 900, 10, bytes([i]) * 50_000) for i in range(12)])
    datasource.register(spark)
    read = spark.read.format("readloom-cram").option("opener", "tests.test_datasource:counting").load(str(path))
    assert read.count() == 13
    whole = _bytes_read(path)
    (r,) = read.where("ref = 1 and start >= 1500 and start < 2500").collect()
    assert (r.container, r.ref, r.start) == (7, 1, 2001) and bytes(r.content).endswith(bytes([6]) * 50_000)
    assert _bytes_read(path) < whole / 4
    assert ranges.files(spark, str(path))[0][1] == path.stat().st_size


def test_reads_of_the_fixture(spark, tmp_path):
    r = reads(spark, SF).selectExpr("*", "'*' as rnext", "0 as pnext", "0 as tlen").where("rname in ('chr1', 'chr2')")
    _write(r, tmp_path / "f")
    a = {(x.rec_idx, x.qname, x.flag, x.cigar, x.seq, x.qual) for x in r.collect()}
    b = [(x.qname, x.flag, x.cigar, x.seq, x.qual) for x in spark.read.format("readloom-bam").load(str(tmp_path / "f")).collect()]
    assert sorted(x[1:] for x in a) == sorted(b)
