"""CRAM framing: bytes made by hand, written, joined and indexed."""

from __future__ import annotations

import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.sources import cram, text
from readloom.sources import cram_blocks as cb


@settings(max_examples=200, deadline=None)
@given(st.integers(-(2**31), 2**31 - 1), st.integers(-(2**63), 2**63 - 1))
def test_numbers(a, b):
    assert cram.varint(cb.itf8(a), 0) == (a, len(cb.itf8(a))) and cram.long_varint(cb.ltf8(b), 0) == (b, len(cb.ltf8(b)))


def test_numbers_by_hand():
    assert [cb.itf8(x).hex() for x in (0, 127, 128, 16383, 16384, -1, 1 << 28)] == ["00", "7f", "8080", "bfff", "c04000", "ffffffff0f", "f100000000"]
    assert [cb.ltf8(x).hex() for x in (127, 128, 1 << 14, -1)] == ["7f", "8080", "c04000", "ff" * 9]


def _crc(b):
    return b + struct.pack("<I", zlib.crc32(b))


def test_a_container_equals_bytes_made_by_hand():
    s = cb.Slice(2, 100, 50, 3, ids=[7], blocks=[cb.block(cb.CORE, 0, b""), cb.block(cb.EXTERNAL, 7, b"abc")])
    made = cb.container([s], b"\1\2", 40, 150)
    head = _crc(b"\0\1\0\2\2\1\2")
    core, ext = _crc(b"\0\5\0\0\0"), _crc(b"\0\4\7\3\3abc")
    inner = b"\2" + b"\x64" + b"\x32" + b"\3" + b"\x28" + b"\2" + b"\1\7" + b"\xff\xff\xff\xff\x0f" + bytes(16)
    held = _crc(b"\0\2\0" + bytes([len(inner)]) * 2 + inner)
    body = head + held + core + ext
    want = _crc(struct.pack("<i", len(body)) + b"\2\x64\x32\3" + b"\x28" + b"\x80\x96" + b"\4" + b"\1" + bytes([len(head)])) + body
    assert made == want
    ((mark, size, back),) = cb.slices_of(made, 3)
    assert (mark, size, back.ref, back.start, back.span, back.n, back.counter, back.ids) == (len(head), len(body) - len(head), 2, 100, 50, 3, 40, [7])
    assert cb.renumbered(made, 40) == made and [x[2].counter for x in cb.slices_of(cb.renumbered(made, 5_000_000), 3)] == [5_000_000]


def test_blocks_are_checked():
    b = cb.block(cb.EXTERNAL, 3, b"x" * 1000)
    assert len(b) < 100 and cb.read_block(b, 0) == (cb.EXTERNAL, 3, b"x" * 1000, len(b))
    with pytest.raises(ValueError, match="checksum"):
        cb.read_block(b[:20] + b"!" + b[21:], 0)
    with pytest.raises(ValueError, match="isn't known"):
        cb.read_block(_crc(b"\4" + b[1:-4]), 0)
    with pytest.raises(ValueError, match="end within"):
        cb.read_block(b[:30], 0)


def _file(path, name, refs):
    out, counter, places = [cb.file_start(f"@HD\tVN:1.6\n@CO\t{name}\n")], 0, []
    for k, own in enumerate(refs):
        slices = [cb.Slice(r, 10 * i + 1 if r >= 0 else 0, 100 if r >= 0 else 0, 5 + i, blocks=[cb.block(cb.EXTERNAL, 1, bytes([k, i]) * (300 + 50 * i))]) for i, r in enumerate(own)]
        c = cb.container(slices, b"map", counter, 1000)
        places.append((sum(map(len, out)), c, slices))
        counter += sum(s.n for s in slices)
        out.append(c)
    path.write_bytes(b"".join([*out, bytes.fromhex(cram.ENDS[3])]))
    return places


def test_index_by_bytes_and_slices_of_several_contigs(spark, tmp_path):
    places = _file(tmp_path / "a.cram", "a", [[0, 0], [cb.SEVERAL], [3], [-1]])
    uri = f"file:{tmp_path}/a.cram"
    rows = cb.byte_index(spark, uri).orderBy("container_offset", "slice").collect()
    data = (tmp_path / "a.cram").read_bytes()
    assert [(r.seq_id, r.container_offset) for r in rows] == [(0, places[0][0]), (0, places[0][0]), (-2, places[1][0]), (3, places[2][0]), (-1, places[3][0])]
    for r in rows:  # an index's place is where the slice's first block is
        _, own = cram._header(data[r.container_offset :], 3)
        at = r.container_offset + own + r.slice_offset
        kind, _, inner, _ = cb.read_block(data, at)
        assert kind == cb.SLICE and cb.slice_header(inner).n == r.records and data[at : at + r.size] == places[[p[0] for p in places].index(r.container_offset)][2][r.slice].bytes()
    spans = spark.createDataFrame([(rows[2].path, places[1][0], 0, i, 7 * i + 1, 50) for i in (1, 2)], "path string, container_offset long, slice int, seq_id int, start int, span int")
    wide = cb.byte_index(spark, uri, spans)
    assert sorted((r.seq_id, r.start, r.span) for r in wide.collect()) == sorted([(0, 1, 100), (0, 11, 100), (1, 8, 50), (2, 15, 50), (3, 1, 100), (-1, 0, 0)])
    text.write_crai(wide, str(tmp_path / "crai"))
    assert sorted(map(tuple, text.read_crai(spark, str(tmp_path / "crai")).collect())) == sorted(map(tuple, wide.select("seq_id", "start", "span", "container_offset", "slice_offset", "size").collect()))


def test_files_are_joined_without_decoding(spark, tmp_path):
    a = _file(tmp_path / "a.cram", "a", [[0, 0], [1]])
    b = _file(tmp_path / "b.cram", "b", [[1], [2, 2], [-1]])
    rows = cb.joined(spark, [f"file:{tmp_path}/a.cram", f"file:{tmp_path}/b.cram"], "@HD\tVN:1.6\n").orderBy("place").collect()
    (tmp_path / "c.cram").write_bytes(b"".join(r.content for r in rows))
    found = cram.containers(spark, f"file:{tmp_path}/c.cram").where("container > 0").orderBy("container").collect()
    n = [sum(s.n for s in p[2]) for p in a + b]
    assert [r.n for r in found] == n and [r.counter for r in found] == [sum(n[:k]) for k in range(len(n))] and [r.ref for r in found] == [0, 1, 1, 2, -1]
    (count,) = cram.counts(cram.containers(spark, f"file:{tmp_path}/c.cram")).collect()
    assert count.records == sum(n) and count.bases == 1000 * len(n)
    with open(tmp_path / "c.cram", "rb") as f:
        assert cb.header_text(f, (tmp_path / "c.cram").stat().st_size)[0] == "@HD\tVN:1.6\n"
    index = cb.byte_index(spark, f"file:{tmp_path}/c.cram").collect()
    assert len(index) == sum(len(p[2]) for p in a + b) and text.is_complete(spark, f"file:{tmp_path}/c.cram").collect()[0].complete
