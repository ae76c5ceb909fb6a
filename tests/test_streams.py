"""Streams with bounded state: what they let go, and how much they hold."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from readloom.operators import pairing
from readloom.operators.cuts import numbered
from readloom.plans.fixtures import reads
from readloom.streaming import bounded, collate

SF = "/root/testdata/sf0.001"


class Store:
    """Stands in for the state of one key."""

    def __init__(self):
        self.states, self.timers, self.most = defaultdict(lambda: None), set(), 0

    def getListState(self, name, schema, ttl=None):
        return _Cell(self, name)

    getValueState = getListState

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Cell:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def exists(self):
        return self.store.states[self.name] is not None

    def get(self):
        return self.store.states[self.name]

    def put(self, values):
        self.store.states[self.name] = list(values)
        self.store.most = max(self.store.most, len(values))

    def update(self, value):
        self.store.states[self.name] = value

    def clear(self):
        self.store.states[self.name] = None


class _Now:
    def __init__(self, at=0):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def _run(processor, batches, end=10**9):
    store = Store()
    processor.init(store)
    out = []
    for b in batches:
        out += [r for pdf in processor.handleInputRows(("k",), iter(b), _Now()) for r in pdf.itertuples(index=False, name=None)]
    for at in sorted(store.timers):
        store.timers.discard(at)
        out += [r for pdf in processor.handleExpiredTimer(("k",), _Now(end), _Now(at)) for r in pdf.itertuples(index=False, name=None)]
    return out, store


def _names(rows):
    return pd.DataFrame([(q, i, 1000 * i) for q, i in rows], columns=["qname", "rec_idx", "at"])


@pytest.mark.parametrize("bound", [0, 1, 3, 100])
def test_open_names_never_exceed_the_bound(bound):
    order = [(f"n{(k * 7) % 20}", k) for k in range(40)] + [("alone", 40), (None, 41)]
    batches = [[_names(order[:5]), _names(order[5:13])], [_names(order[13:])]]
    out, store = _run(bounded.OpenNames(bound, 10), batches)
    assert store.most <= bound and all(s is None or len(s) <= bound for s in store.states.values())
    pairs = {(q, a, b) for q, a, b in out if b != -1}
    left = sorted((q, a) for q, a, b in out if b == -1)
    assert sorted([*(a for _, a, _ in pairs), *(b for _, _, b in pairs), *(a for _, a in left)]) == list(range(41))
    assert len(pairs) == (20 if bound == 100 else 0)  # mates are twenty apart


def test_overflow_is_put_together_by_name(spark):
    order = [(f"n{(k * 7) % 20}", k) for k in range(40)] + [("alone", 40)]
    want = {(f"n{(k * 7) % 20}", k, k + 20) for k in range(20)} | {("alone", 40, -1)}
    for bound in (0, 1, 3, 7):
        out, _ = _run(bounded.OpenNames(bound, 10), [[_names(order)]])
        got = bounded.reconciled(spark.createDataFrame(out, bounded.EMITTED)).collect()
        assert {tuple(r) for r in got} == want and len(got) == 21
    assert bounded.reconciled(spark.createDataFrame([], bounded.EMITTED)).collect() == []


def test_names_wait_no_longer_than_told():
    p, store = bounded.OpenNames(10, 5000), Store()
    p.init(store)
    assert list(p.handleInputRows(("k",), iter([_names([("a", 1), ("b", 9)])]), _Now())) == [] and store.timers == {14_000}
    (gone,) = p.handleExpiredTimer(("k",), _Now(7000), _Now(6000))
    assert gone["qname"].tolist() == ["a"] and store.timers == {14_000}


def _starts(rows):
    return pd.DataFrame([(p, s, 1000) for p, s in rows], columns=["pos", "stop", "at"])


def test_positions_leave_once_and_little_is_held():
    spans = [(p, p + 40 + p % 7) for p in range(1, 5000, 3)] + [(7000, 7100)] * 3
    batches = [[_starts(reversed(spans[k : k + 100]))] for k in range(0, len(spans), 100)]
    out, store = _run(bounded.OpenPositions(5), batches)
    depth = defaultdict(int)
    for p, s in spans:
        for x in range(p, s):
            depth[x] += 1
    got = {}
    for _, a, b, n in out:
        for x in range(a, b):
            assert x not in got
            got[x] = n
    assert got == dict(depth)
    # alignments of 46 letters at most that begin each third letter: some 16 are open, however long the contig
    assert store.most <= 20 and store.states["ends"] is None


def test_a_step_back_is_an_error():
    p = bounded.OpenPositions(5)
    p.init(Store())
    list(p.handleInputRows(("chr1",), iter([_starts([(100, 120)])]), _Now()))
    with pytest.raises(ValueError, match="order of position"):
        list(p.handleInputRows(("chr1",), iter([_starts([(99, 120)])]), _Now()))


def test_bounded_pairs_equal_the_batch_pairs_and_state_is_small(spark):
    r = reads(spark, SF).withColumn("qname", F.expr("concat('t', cast((rec_idx * 37) % 400 as string))")).where("rec_idx < 900")
    # each name twice or more would pair two by two: keep the first two of each
    r = numbered(r.select("qname", "rec_idx"), ["rec_idx"], "place", 2).selectExpr("qname", "place as rec_idx").where("rec_idx <= 700")
    events = r.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("rec_idx")))
    held = []
    with bounded.stateful(spark):
        emitted = collate.replay(
            spark, events, lambda s: bounded.pair_bounded(s, 40, 2, "30 days"), "append", seen=lambda q: held.extend(x["stateOperators"][0]["numRowsTotal"] for x in q.recentProgress if x["stateOperators"]),
        )
    n = events.groupBy("qname").count().where("count > 2").count()
    assert n == 0
    want = {(x.qname, x.rec_a, -1 if x.rec_b is None else x.rec_b) for x in pairing.by_name(events).collect()}
    assert {tuple(x) for x in bounded.reconciled(emitted).collect()} == want
    assert emitted.where("rec_b = -1").count() > 100 and held
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None or "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
