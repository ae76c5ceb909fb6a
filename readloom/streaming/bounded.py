"""Streams whose state is bounded by size or by position, not by time alone.

Both operators are stateful processors. They need a state store that keeps several states for a key: see stateful().

`pair_bounded` holds at most so many open names. When there are more, the older half leave for an overflow; what was split so, a
record that has left and a mate that came later, is put together afterwards by sorting the overflow by name (`reconciled`).

`coverage_stream` takes records in order of position. A position is final once the contig's stream has passed it; it leaves
then, and only the ends of the alignments that are still open are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

EMITTED = "qname string, rec_a long, rec_b long"
RUNS = "rname string, begin long, stop long, coverage long"
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def stateful(spark: SparkSession):
    """While a query of these operators starts: the session's state store is the one that they need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def _due(handle, at: int) -> None:
    """One timer for a key: the latest."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    handle.registerTimer(at)


class OpenNames(StatefulProcessor):
    """The open names of one share of all names: at most `bound`, oldest first."""

    def __init__(self, bound: int, wait: int):
        self.bound, self.wait = bound, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "qname string, rec long, at long")

    def _keep(self, held: dict) -> None:
        if held:
            self.open.put([(q, rec, at) for q, (rec, at) in held.items()])
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {q: (rec, at) for q, rec, at in self.open.get()} if self.open.exists() else {}
        for pdf in rows:
            out = []
            came = pdf[pdf["qname"].notna()].sort_values("rec_idx")
            for q, rec, at in came[["qname", "rec_idx", "at"]].itertuples(index=False):
                first = held.pop(q, None)
                if first is not None:
                    out.append((q, *sorted((first[0], int(rec)))))
                    continue
                if len(held) >= self.bound:  # the older half leave, at least one
                    for old in list(held)[: max(1, len(held) // 2)]:
                        out.append((old, held.pop(old)[0], -1))
                if self.bound:
                    held[q] = (int(rec), int(at))
                else:
                    out.append((q, int(rec), -1))
            if out:
                yield pd.DataFrame(out, columns=["qname", "rec_a", "rec_b"])
        self._keep(held)
        if held:
            _due(self.handle, max(timerValues.getCurrentWatermarkInMs() + 1, *(at for _, at in held.values())) + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() - self.wait
        held = {q: (rec, at) for q, rec, at in self.open.get()} if self.open.exists() else {}
        gone = [q for q, (_, at) in held.items() if at <= passed]
        out = [(q, held.pop(q)[0], -1) for q in gone]
        self._keep(held)
        if held:
            _due(self.handle, max(at for _, at in held.values()) + self.wait)
        if out:
            yield pd.DataFrame(out, columns=["qname", "rec_a", "rec_b"])


def pair_bounded(reads: DataFrame, bound: int = 100_000, shares: int = 200, wait: str = "10 minutes") -> DataFrame:
    """qname, rec_a, rec_b: a pair as its second record comes; with a rec_b of -1 a record that had to leave, as `bound` names were open (over all shares) or its mate hadn't come within `wait`.

    reads: a stream with qname, rec_idx and an event time `ts`; rows without a name are left out. Records of a name pair in the order in which they
    come. Names are dealt into shares, each with its part of the bound, so no task holds more than bound / shares names.
    """
    ms = pd.Timedelta(wait) // pd.Timedelta("1ms")
    # rows are left out by the processor: a filter would be pushed below the watermark, which must see all times
    r = reads.withWatermark("ts", wait).select(F.pmod(F.xxhash64("qname"), F.lit(shares)).alias("share"), "qname", "rec_idx", F.unix_millis("ts").alias("at"))
    return r.groupBy("share").transformWithStateInPandas(OpenNames(bound // shares, ms), EMITTED, "Append", "EventTime")


def reconciled(emitted: DataFrame) -> DataFrame:
    """qname, rec_a, rec_b of all that pair_bounded() has let go: its pairs, those of the overflow (its records, sorted by name, pair two by two), and with a rec_b of -1 records without a mate."""
    left = emitted.where("rec_b = -1")
    by_name = Window.partitionBy("qname").orderBy("rec_a")
    left = left.select("qname", "rec_a", F.row_number().over(by_name).alias("i"), F.lead("rec_a").over(by_name).alias("next")).where("i % 2 = 1")
    return emitted.where("rec_b <> -1").unionByName(left.select("qname", "rec_a", F.coalesce("next", F.lit(-1)).alias("rec_b")))


class OpenPositions(StatefulProcessor):
    """One contig: where the stream is, the depth there, and how the depth changes further on."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "at long, depth long")
        self.ends = handle.getListState("ends", "at long, n long")

    def _advance(self, at: int, depth: int, ends: dict[int, int], upto: int):
        """The runs of positions before `upto`, and the depth there; ends that are passed are taken out."""
        runs = []
        for end in sorted(e for e in ends if e <= upto):
            if depth and end > at:
                runs.append((at, end, depth))
            at, depth = max(at, end), depth - ends.pop(end)
        if depth and upto > at:
            runs.append((at, upto, depth))
        return runs, depth

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        came = came[came["pos"].notna()].sort_values("pos")
        if came.empty:
            return
        at, depth = self.place.get() if self.place.exists() else (0, 0)
        ends = dict(self.ends.get()) if self.ends.exists() else {}
        if int(came["pos"].iloc[0]) < at:
            raise ValueError(f"{key[0]}: position {int(came['pos'].iloc[0])} comes after {at}: the stream isn't in order of position")
        out = []
        for pos, stop in came[["pos", "stop"]].itertuples(index=False):
            if pos > at:
                runs, depth = self._advance(at, depth, ends, int(pos))
                out += runs
                at = int(pos)
            depth += 1
            ends[int(stop)] = ends.get(int(stop), 0) + 1
        self.place.update((at, depth))
        self.ends.put(sorted(ends.items()))
        _due(self.handle, max(int(came["at"].max()), timerValues.getCurrentWatermarkInMs() + 1) + self.wait)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["rname", "begin", "stop", "coverage"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The contig is through."""
        at, depth = self.place.get()
        ends = dict(self.ends.get())
        runs, _ = self._advance(at, depth, ends, max(ends))
        self.place.clear()
        self.ends.clear()
        if runs:
            yield pd.DataFrame([(key[0], *r) for r in runs], columns=["rname", "begin", "stop", "coverage"])


def coverage_stream(reads: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """rname, ref_pos, coverage: reads over each position, each position once, as soon as the contig's stream has passed it; the last ones when nothing has come for `wait`.

    reads: a stream in order of contig and position, with flag, rname, pos, aln_end and an event time `ts`. A step back within a contig is
    an error. State: one number for each end of an alignment over the place where the stream is.
    """
    ms = pd.Timedelta(wait) // pd.Timedelta("1ms")
    takes_part = F.expr("flag & 4 = 0 and aln_end >= pos and rname is not null")
    # the others are left out by the processor: a filter would be pushed below the watermark, which must see all times
    r = reads.withWatermark("ts", wait).select("rname", F.when(takes_part, F.col("pos")).cast("long").alias("pos"), (F.col("aln_end") + 1).cast("long").alias("stop"), F.unix_millis("ts").alias("at"))
    runs = r.groupBy("rname").transformWithStateInPandas(OpenPositions(ms), RUNS, "Append", "EventTime")
    return runs.select("rname", F.explode(F.sequence(F.col("begin").cast("int"), F.col("stop").cast("int") - 1)).alias("ref_pos"), "coverage")
