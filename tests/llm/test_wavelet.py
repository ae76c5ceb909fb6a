"""Token ids in wavelet matrices: round trips, occurrences, and the library's own encoding of whole texts."""

from __future__ import annotations

import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from readloom.llm import wavelet
from tests.llm.helpers import EDGES, docs


def _shard(a, lengths=None):
    lengths = [len(a)] if lengths is None else lengths
    return wavelet.Shard(io.BytesIO(wavelet.build(np.array(a), pa.array(range(len(lengths)), pa.int64()), np.array(lengths))))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 2**32 - 1), max_size=200))
def test_access_rank_and_select(a):
    s = _shard(a)
    assert s.all().tolist() == a and [s.access(i) for i in range(len(a))] == a and s.tokens(0, len(a)).tolist() == a
    for t in {*a[:5], 0, 7}:
        at = [i for i, x in enumerate(a) if x == t]
        assert s.occurrences(t) == at and s.count(t) == len(at)
        for i in (0, len(a) // 2, len(a)):
            assert s.rank(t, i) == sum(x == t for x in a[:i])
        with pytest.raises(IndexError):
            s.select(t, len(at))
    with pytest.raises(IndexError):
        s.access(len(a))


def test_several_blocks_and_compression():
    a = np.random.default_rng(1).zipf(1.4, 300_000) % 40_000
    data = wavelet.build(a, pa.array([1, 2]), np.array([100_000, 200_000]))
    assert len(data) < 1.5 * len(a)
    s = wavelet.Shard(io.BytesIO(data))
    assert (s.all() == a).all() and (s.tokens(65_000, 200_000) == a[65_000:200_000]).all()
    for t in (1, 2, 39, 30_001):
        at = np.flatnonzero(a == t)
        assert s.count(t, 70_000, 250_000) == ((at >= 70_000) & (at < 250_000)).sum()
        assert [s.select(t, k) for k in range(0, len(at), max(1, len(at) // 7))] == at[:: max(1, len(at) // 7)].tolist()


class _Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        b = super().read(n)
        self.taken += len(b)
        return b


def test_one_id_takes_few_blocks():
    f = _Counting(wavelet.build(np.random.default_rng(2).integers(0, 1 << 15, 2_000_000), pa.array([1]), np.array([2_000_000])))
    s = wavelet.Shard(f)
    f.taken = 0
    s.access(1_234_567)
    assert f.taken <= 15 * wavelet.BLOCK // 8


def test_a_foreign_file_is_an_error():
    with pytest.raises(ValueError):
        wavelet.Shard(io.BytesIO(b"something else than a shard of ids"))


TEXTS = ["It's we'll I'M", "á ́b é", "ΣΑΣ ΣΑΣ. ς", "x y z w\x1cv", "<|endoftext|> a<|startoftext|>b <|", "½ ٣ 12 3.5", "ﬁ Å K ẞ ß", "🙂🙂 \U0001d11e", "don't'st've\t\n\x0b\x0c\r'd", "\x85\x00\x01"]


def test_words_encode_as_the_library_does_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        ours = wavelet.WordEncoder(f.read())
    texts = TEXTS + [t for _, t, *_ in EDGES]
    lib = Tokenizer.from_file(path)
    assert [x.tolist() for x in ours.encode(texts)] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("shard", [1 << 22, 40, 1])
def test_files_give_back_all_documents(spark, tmp_path, shard):
    rows = [(r[0], r[1]) for r in EDGES] + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(500, "tie")] * 3 + [(500, "other tie")]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    table = docs(spark, rows)
    files = wavelet.placed(wavelet.write(table, str(tmp_path / "ids"), shard=shard)).cache()
    assert files.count() >= (1 if shard > 100 else 8) and len(list((tmp_path / "ids").iterdir())) == files.count()
    got = wavelet.read(files).collect()
    want = sorted((-1 if i is None else i, (*lib.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in got) == want
    by_start = sorted(got, key=lambda r: r.start)
    at, last = 0, -1
    for r in by_start:
        assert r.start == at and r.n_tokens == len(r.ids) and (-1 if r.doc_id is None else r.doc_id) >= last
        at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    places = {p.path: p.places for p in wavelet.find(files, 2).collect()}
    assert sum(map(len, places.values())) >= len(rows)


def test_written_again_the_same_and_empty(spark, tmp_path):
    table = docs(spark, [(i, f"words of {i} " * 9) for i in range(50)])
    a, b = (wavelet.write(table, str(tmp_path / k)).collect() for k in "ab")
    strip = lambda rows: sorted((r.part, r.nth, r.docs, r.tokens, zlib.crc32(open(r.path, "rb").read())) for r in rows)
    assert strip(a) == strip(b)
    assert wavelet.read(wavelet.placed(wavelet.write(docs(spark, []), str(tmp_path / "none")))).collect() == []


def test_ids_of_other_types(spark, tmp_path):
    t = spark.createDataFrame([("b", "one two", 1), ("a", "three", 2), (None, "x", 3)], "doc_id string, text string, tokens long")
    got = wavelet.read(wavelet.placed(wavelet.write(t, str(tmp_path))), "string").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, "a", "b"]
