"""Odd rows through whole operators and the pipeline: clashing columns, nulls, repeats, odd white space, long texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from readloom.llm import pitman_yor
from tests.llm.helpers import EDGES, docs

CLASH = {"bucket": "1L", "chunk": "'x'", "lot": "2", "payload": "cast('p' as binary)", "size": "3L", "key": "4L", "row": "5L", "base": "6", "limit": "7", "score": "0.5D", "kept": "false", "copies": "9L"}


def _clashing(spark, rows):
    return docs(spark, rows).selectExpr("*", *(f"{v} as {k}" for k, v in CLASH.items()))


def test_pitman_yor_on_odd_rows(spark):
    rows = EDGES + [(100 + i, f"the cat sat on mat {i % 3}") for i in range(30)]
    got = pitman_yor.scores(_clashing(spark, rows)).collect()
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    train = Counter(w for i, t, *_ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in words(t))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t, *_ in rows:
        w = words(t)
        want[i, len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_tokens), set()).add(round(r.score, 9))
    assert len(by[5, 12]) == 1  # repeated rows


def test_parts_of_contexts_have_keys_of_their_own():
    name, part = np.array([5, 6, 5, 5]), np.array([70_000, 0, 65_536, 0])
    assert len(set(pitman_yor.part_key(name, part).tolist())) == 4
    assert pitman_yor.part_key(np.array([(1 << 39) - 1]), np.array([(1 << 24) - 1]))[0] == (1 << 63) - 1
    for n, k in ((1, 1 << 24), (1 << 39, 0)):
        with pytest.raises(OverflowError):
            pitman_yor.part_key(np.array([n]), np.array([k]))


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    good = "Here is a plain sentence about number {} and other things, which nobody has written before in quite this way. It goes on a little."
    rows = EDGES + [(200 + i, good.format(f"{i} {i * 7919 % 1000}") + " password = hunter2hunter2 " * (i % 4 == 0)) for i in range(60)] + [(200, good.format("0 0"))] * 2
    _clashing(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = table.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        table = stage(spark, table, str(tmp_path))
        assert table.columns == columns
        table.write.parquet(str(tmp_path / f"stage-{k}"))
        table = spark.read.parquet(str(tmp_path / f"stage-{k}"))
    assert all("hunter2" not in (r.text or "") for r in table.collect())
    ids = Counter(r.doc_id for r in table.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == ids and all(r.n_tokens > 0 for r in out)
