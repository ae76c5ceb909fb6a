"""FASTA files by their headers' references, and sealed files."""

from __future__ import annotations

import os
import random
import zlib

import pytest

from readloom.sources import bam, datasource, fasta, sealed


def _fasta(folder, name, contigs, width, compressed):
    text, index = b"", []
    for n, s in contigs:
        text += f">{n} about\n".encode()
        index.append(f"{n}\t{len(s)}\t{len(text)}\t{width}\t{width + 1}")
        text += b"".join(s[i : i + width].encode() + b"\n" for i in range(0, len(s), width))
    (folder / name).write_bytes(bam.deflate(text, 5000) if compressed else text)
    (folder / f"{name}.fai").write_text("\n".join(index) + "\n")


def test_references_of_a_header_from_many_files(spark, tmp_path):
    rng = random.Random(4)
    seqs = {f"c{i}": "".join(rng.choices("ACGTacgt", k=n)) for i, n in enumerate((1, 59, 60, 61, 9000, 123_457, 2_400_000))}
    _fasta(tmp_path, "a.fa", [(n, seqs[n]) for n in ("c0", "c4", "c2")], 60, False)
    _fasta(tmp_path, "b.fa.gz", [(n, seqs[n]) for n in ("c1", "c6", "c3")], 70, True)
    _fasta(tmp_path, "c.fa", [("c5", seqs["c5"])], 61, False)
    where = {"c0": "a.fa", "c4": "a.fa", "c2": "a.fa", "c1": "b.fa.gz", "c6": "b.fa.gz", "c3": "b.fa.gz", "c5": "c.fa"}
    lines = [f"@SQ\tSN:{n}\tLN:{len(s)}\tUR:{'file:' if k % 2 else ''}{tmp_path}/{where[n]}" for k, (n, s) in enumerate(seqs.items())] + ["@HD\tVN:1.6", "@SQ\tSN:lost\tLN:5"]
    d = fasta.dictionary_of(spark.createDataFrame([(x,) for x in lines], "value string"))
    wanted = [(n, 1, len(s)) for n, s in seqs.items()] + [("c6", a, a + rng.randint(0, 9000)) for a in rng.sample(range(1, 2_400_000), 60)] + [("c5", 123_000, 999_999), ("c5", 123_458, 123_460), ("c4", 0, 5), ("lost", 1, 2), ("none", 1, 1)]
    got = {(r.rname, r.start, r.stop): r.seq for r in fasta.by_header(d, spark.createDataFrame(wanted, "rname string, start long, stop long"), 5).collect()}
    for n, a, b in wanted:
        ok = n in seqs and 1 <= a <= len(seqs[n])
        assert got[n, a, b] == (seqs[n][a - 1 : b].upper() if ok else None), (n, a, b)
    held = fasta.blocks(d.selectExpr("concat('file:', regexp_replace(ur, '^file:', '')) as path")).collect()
    assert {os.path.basename(r.path) for r in held} == {"b.fa.gz"} and sum(r.size for r in held) == len(bam.inflate((tmp_path / "b.fa.gz").read_bytes()))


KEY = "0123456789abcdef"


def _content(rows):
    by = {}
    for r in rows:
        by.setdefault(r.name.rpartition("/")[2], []).append((r.begin, bytes(r.content)))
    return {n: b"".join(c for _, c in sorted(x)) for n, x in by.items()}


@pytest.mark.parametrize("block,blocks", [(64, 3), (1000, 1024)])
def test_sealed_files_open_whole_and_in_part(spark, tmp_path, block, blocks):
    rng = random.Random(8)
    files = {f"f{n}": rng.randbytes(n) for n in (1, 63, 64, 65, 1000, 5000)}
    (tmp_path / "in").mkdir()
    for n, c in files.items():
        (tmp_path / "in" / n).write_bytes(c)
    sealed.seal(spark, str(tmp_path / "in"), str(tmp_path / "out"), KEY, block, blocks)
    for n, c in files.items():
        parts = [p for p in os.listdir(tmp_path / "out" / n) if p.startswith("part-")]
        held = b"".join((tmp_path / "out" / n / p).read_bytes() for p in sorted(parts))
        assert len(held) == sealed.packed_size(len(c), block) and (len(c) < 64 or c[:64] not in held)
    assert _content(sealed.opened(spark, str(tmp_path / "out"), KEY).collect()) == files
    for a, b in ((0, 1), (63, 130), (999, 1000), (1000, 4096), (4990, 9000)):
        assert _content(sealed.opened(spark, str(tmp_path / "out"), KEY, a, b).collect()) == {n: c[a:b] for n, c in files.items() if len(c) > a}


def test_a_stretch_opens_only_its_blocks_and_changes_are_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_bytes(bytes(range(256)) * 40)
    sealed.seal(spark, str(tmp_path / "in"), str(tmp_path / "out"), KEY, 1024, 4)
    part = tmp_path / "out" / "x" / "part-0000000001"
    good = part.read_bytes()
    size = 1024 + sealed.OVER
    part.write_bytes(good[: size + 30] + bytes([good[size + 30] ^ 1]) + good[size + 31 :])  # block 5
    read = lambda *at: b"".join(bytes(r.content) for r in sealed.opened(spark, str(tmp_path / "out"), KEY, *at).orderBy("begin").collect())
    assert read(0, 4096) == bytes(range(256)) * 16 and len(read(6144, 7000)) == 856
    with pytest.raises(Exception, match="AES|Tag|decrypt|CRYPTO"):
        read(5000, 5200)
    part.write_bytes(good[size : 2 * size] + good[:size] + good[2 * size :])  # two blocks have changed places
    with pytest.raises(Exception, match="AES|Tag|decrypt|CRYPTO"):
        read(4096, 4100)
    part.write_bytes(good)
    with pytest.raises(Exception, match="AES|Tag|decrypt|CRYPTO"):
        sealed.opened(spark, str(tmp_path / "out"), KEY[::-1]).collect()
    assert zlib.crc32(read()) == zlib.crc32(bytes(range(256)) * 40)


def test_files_are_put_in_place(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/a/b", bytearray(b"1")), (f"file:{tmp_path}/c", bytearray(b"2"))], "path string, content binary")
    assert datasource.put(rows) == 2 and (tmp_path / "a" / "b").read_bytes() == b"1" and sorted(os.listdir(tmp_path)) == ["a", "c"]


def test_ranges_of_many_files_come_one_a_task(spark, tmp_path):
    """Ranges cover every byte of every file once, in order, each in a partition of its own; an empty file has none."""
    from readloom.sources import ranges

    sizes = {"a": 1000, "b": 0, "c": 1, "d": 250, "e": 251, "f": 999}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(bytes(n))
    got = ranges.splits(spark, str(tmp_path), 250)
    want = [(n, at, min(at + 250, size), size) for n, size in sizes.items() for at in range(0, size, 250)]
    assert got.columns == ["part", "path", "begin", "stop", "length"] and got.rdd.getNumPartitions() == len(want)
    assert [len(x) for x in got.rdd.glom().collect()] == [1] * len(want)
    rows = got.collect()
    assert [(r.path.rsplit("/", 1)[1], r.begin, r.stop, r.length) for r in rows] == want and [r.part for r in rows] == list(range(len(want)))
    some = ranges.tasks(spark, [("x", 0, 5, 5), ("y", 5, 9, 9), ("z", 1, 2, 3)])
    assert [[r.path for r in x] for x in some.rdd.glom().collect()] == [["x"], ["y"], ["z"]]
    nothing = tmp_path / "none"
    nothing.mkdir()
    (nothing / "empty").write_bytes(b"")
    assert ranges.splits(spark, str(nothing), 250).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_fastq_scores_that_begin_with_the_mark_of_a_record(spark, tmp_path, share):
    """Records cut in two by their scores, within and across many small partitions and several files; whole ones aren't shuffled."""
    from readloom.sources import text

    r, want = random.Random(int(share * 10)), []
    for file in range(2):
        rows = []
        for i in range(150):
            n = r.randint(1, 30)
            seq = "".join(r.choice("ACGTN") for _ in range(n))
            qual = ("@" if r.random() < share else "I") + "".join(r.choice("@+!5I") for _ in range(n - 1))
            rows.append((f"r{file}.{i}", r.choice([0, 1, 2]), seq, qual))
        (tmp_path / f"{file}.fq").write_text("".join(f"@{n}{f'/{s}' if s else ''}\n{q}\n+\n{v}\n" for n, s, q, v in rows))
        want += rows
    sizes = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "1b"}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        got = text.read_fastq(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
        rows = got.collect()
    finally:
        for k in sizes:
            spark.conf.unset(k)
    assert sorted((x.name, x.segment, x.seq, x.qual) for x in rows) == sorted(want)
    of_file = [[x.name for x in sorted(rows, key=lambda x: x.rec_idx) if x.name.startswith(f"r{f}.")] for f in range(2)]
    assert of_file == [[f"r{f}.{i}" for i in range(150)] for f in range(2)]
