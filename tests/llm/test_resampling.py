"""Importance resampling against plain Python, at one and at many ranges and steps."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from readloom.llm import resampling
from tests.llm.helpers import DOCS, EDGES, docs

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(rows, target, draw=25, least=20):
    feats = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = _WORD.findall(low)
        feats.append((i, w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, _, fs in feats for f in fs)
    t = Counter()
    for x in target:
        w = _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
        t.update(bucket(f) for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, w, fs in feats:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * draw // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def _corpus():
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "été", "x9", "中文", "don't", "a_b", "z"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 3, 19, 20, 21, 60])))) for i in range(120)]
    rows += [(7, rows[7][1])] * 3 + [(200 + i, "same words again and again " * 5) for i in range(30)] + [(300, "long " * 40_000)]
    return rows + [(x[0], x[1]) for x in EDGES]


TARGET = ["w1 w2 w3 alpha Beta", None, "", "été w1 w1 only-here"]


@pytest.mark.parametrize("sizes", [(24 << 20, 5 << 20, 13), (500, 300, 2)])
def test_resampling_equals_plain_python(spark, monkeypatch, sizes):
    for name, v in zip(("CHUNK_BYTES", "RANGE_BYTES", "FAN"), sizes, strict=True):
        monkeypatch.setattr(resampling, name, v)
    rows = _corpus()
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    table = docs(spark, rows)
    got = Counter(map(tuple, resampling.resample(table, target).collect()))
    assert got == plain(rows, TARGET)
    assert sum(r[4] is not None for r in got.elements()) == sum(len(_WORD.findall(t or "")) >= 20 for _, t in rows) * 25 // 100
    if sizes[2] == 2:
        assert len(resampling.Route(resampling.estimated_bytes(table)).upto) > 3


def test_dictionary_holds_each_string_once(spark, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 300)
    monkeypatch.setattr(resampling, "RANGE_BYTES", 500)
    rows = _corpus()[:40]
    target = spark.createDataFrame([(1, "w1 w2 new")], "item_id long, text string")
    found = resampling.features(docs(spark, rows), target).collect()
    n = Counter()
    for _, t in rows:
        w = _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        n.update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    assert len(found) == len({r.feature for r in found})
    assert {r.feature: r.n for r in found if r.n} == dict(n) and all(r.bucket == zlib.crc32(r.feature.encode()) % 10000 for r in found)
    assert {r.feature: r.n_target for r in found if r.n_target} == dict.fromkeys(["w1", "w2", "new", "w1 w2", "w2 new"], 1)


def test_empty_tables(spark):
    none, target = docs(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(none, target).collect() == []
    rows = [(1, ""), (2, None), (3, "a b")]
    assert Counter(map(tuple, resampling.resample(docs(spark, rows), target).collect())) == plain(rows, [])


def test_packs_give_back_their_features():
    f = [b"a", b"b", b"a b", b"a c", b"b", b"b a", b"c d", b"c e"]
    assert resampling.spread(resampling.squeezed(f)) == f and resampling.squeezed(f).count(b"\n c") == 1
    for x in ([], [0, 5, 70_000], [-3, 8], [1 << 40]):
        a = np.array(x, np.int64)
        assert (np.cumsum(resampling._steps(a), dtype=np.int64) == a).all() and (resampling._unplanes(*resampling._planes(np.abs(a))) == np.abs(a)).all()


def test_extra_columns_are_ignored(spark):
    rows = [(i, f"some words here {i} " * 8) for i in range(12)]
    target = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    t = spark.createDataFrame([(i, x, "en", "s", 1, 5, b"x") for i, x in rows], DOCS + ", bucket long, payload binary")
    assert Counter(map(tuple, resampling.resample(t, target).collect())) == plain(rows, ["some words"])
