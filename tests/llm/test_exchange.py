"""The language model's exchange: several steps say the same as one, and what is sent doesn't grow with the number of buckets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from readloom.llm import pitman_yor
from tests.llm.helpers import docs


def _scores(spark, rows):
    got = pitman_yor.scores(docs(spark, rows).repartition(3, "doc_id")).collect()
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in got)


def test_several_steps_give_the_scores_of_one(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices("the of and a cat dog sat runs far".split(), k=r.randint(0, 50))) + f" rare{i}") for i in range(120)] + [(1, None), (2, ""), (None, "the of"), (7, "the of"), (7, "the of")]
    for k, v in (("CHUNK_BYTES", 1500), ("BUCKET_TOKENS", 250)):
        monkeypatch.setattr(pitman_yor, k, v)
    one = _scores(spark, rows)
    monkeypatch.setattr(pitman_yor, "FAN", 2)
    assert len(pitman_yor.Route(4, 10).upto) == 2 and _scores(spark, rows) == one
    monkeypatch.setattr(pitman_yor, "FAN", 1)
    assert len(pitman_yor.Route(4, 10).upto) == 4 and _scores(spark, rows) == one


def _chunk(words: int):
    r, c = random.Random(4), pitman_yor._Chunk()
    for i in range(300):
        c.add(i, " ".join(f"w{int(r.paretovariate(0.7)) % words}" for _ in range(100)))
    return c


def test_packs_of_a_chunk_are_bounded_at_any_number_of_buckets(monkeypatch):
    monkeypatch.setattr(pitman_yor, "FAN", 4)
    chunk, sent = _chunk(3000), {}
    for bits in (4, 8, 12):
        route = pitman_yor.Route(bits, 1 << bits)
        rows = list(chunk.rows(7, route, {}))
        assert len(rows) == 1 + 2**4 and max(x[1] for x in rows if x[0] == pitman_yor.WORDS) < 2**4
        sent[bits] = sum(len(x[3]) for x in rows)
    assert sent[4] == sent[8] == sent[12]


def test_dealing_and_returning_keep_each_chunks_order(monkeypatch):
    """Words of many chunks through three steps: the bucket sees each once, and each chunk gets answers in the order it asked."""
    monkeypatch.setattr(pitman_yor, "FAN", 2)
    route, r = pitman_yor.Route(6, 40), np.random.default_rng(2)
    assert len(route.upto) == 3 and len(route.lots) == 2
    asked, rows = {}, []
    for chunk in range(40):
        h = np.unique(r.integers(0, 1 << 64, r.integers(0, 60), np.uint64, endpoint=False))
        asked[chunk] = h
        to = pitman_yor._by_hash(h, 2)
        for b in range(route.fan):
            rows.append((pitman_yor.WORDS, b, route.lot(chunk, 1), pitman_yor.encode([chunk], [(to == b).sum()], [h[to == b], np.ones((to == b).sum(), np.int64)], "ap")))

    def step(f, rows, key):
        by = {}
        for x in rows:
            by.setdefault(key(x), []).append(x)
        return [tuple(x.values()) for v in by.values() for x in f(pitman_yor._rows(v)).to_pylist()]

    for s in range(2):
        rows = step(lambda t, s=s: pitman_yor._deal(t, route, s), rows, lambda x: x[:3])
    assert {x[1] for x in rows} == set(range(64))
    rows = step(lambda t: pitman_yor._count_words(t, route), rows, lambda x: x[:2])
    for s in (1, 0):
        rows = step(lambda t, s=s: pitman_yor._return(t, route, s), rows, lambda x, s=s: (x[0], x[1] >> route.children(s), x[2]))
    every = np.unique(np.concatenate(list(asked.values())))
    for chunk, h in asked.items():
        mine = sorted((x[1], pitman_yor.decode(x[3])) for x in rows if x[2] == chunk)
        place, total, bucket = pitman_yor._columns([x for _, x in mine])
        at = pitman_yor._by_hash(every, 6)
        rank = np.arange(len(every)) - np.searchsorted(at, at)
        i = np.searchsorted(every, h)
        assert (bucket == at[i]).all() and (place == rank[i]).all() and (total == 1).all()
        assert sum(x[4][0] for _, x in mine) == sum(len(x) for x in asked.values())


@pytest.mark.parametrize("counts", [[0, 3, 0, 2], [0], [5]])
def test_forms_of_columns_round_trip(counts):
    r, n = np.random.default_rng(1), sum(counts)
    rise = np.concatenate([np.sort(r.integers(0, 900, k)) for k in counts])
    dish = r.integers(0, 3, n)
    cols = [r.random(n).astype(np.float32), rise, np.sort(dish), np.zeros(n, np.int64), dish * 7]
    cols[2] = dish
    members, got_counts, got, forms, extra = pitman_yor.decode(pitman_yor.encode(range(len(counts)), counts, cols, "adrpo", 4, 2.5))
    assert members.tolist() == list(range(len(counts))) and got_counts.tolist() == counts and extra == (4, 2.5)
    assert all(np.array_equal(a, b) for a, b in zip(cols, got, strict=True))
