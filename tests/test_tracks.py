"""Tracks of counts, windows that are met once, and scores by pileup without a shuffle of bases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import lossy, pileup, tracks
from readloom.plans import catalog
from readloom.plans.fixtures import reads, ref

SF = "/root/testdata/sf0.001"


def _reads(spark, rows):
    return spark.createDataFrame(rows, "rec_idx long, rname string, pos int, n int")


@pytest.mark.parametrize("tile,cell", [(1 << 16, 256), (64, 8), (32, 32)])
def test_counts_of_positions(spark, tile, cell):
    rng = random.Random(tile)
    runs, at = [], {"a": 1, "b": 1}
    want = {"a": {}, "b": {}}
    for _ in range(150):
        c = rng.choice("ab")
        begin = at[c] + rng.choice([0, 0, 1, 9, 70])
        stop = begin + rng.choice([1, 2, 5, 40, 130])
        n = rng.randint(1, 9)
        runs.append((c, begin, stop, n))
        want[c].update(dict.fromkeys(range(begin, stop), n))
        at[c] = stop
    asked = [(i, rng.choice("abz"), rng.randint(-2, 3000), rng.choice([0, 1, 7, 31, 300])) for i in range(120)]
    track = tracks.build(spark.createDataFrame(runs, "rname string, begin int, stop int, n int"), tile, cell)
    contigs = spark.createDataFrame([("a", "N" * 9000), ("b", "N" * 9000)], "rname string, seq string")
    got = tracks.with_counts(_reads(spark, asked), track, contigs, F.col("pos") + F.col("n") - 1, "counts", tile, cell).collect()
    assert len(got) == len(asked)
    for r in got:
        first = max(r.pos, 1)
        expected = [want.get(r.rname, {}).get(p, 0) for p in range(first, r.pos + r.n)]
        have = list(r.counts or [])
        assert have + [0] * (len(expected) - len(have)) == expected, (r, expected)


def test_short_windows_give_the_same_scores(spark, monkeypatch):
    r, contigs = reads(spark, SF).where("rec_idx < 400").cache(), ref(spark, SF).cache()
    for spec in ("R40X10-N40", "P1_40", "X3P2", "R8I40X2-D8"):
        a = {x.rec_idx: x.qual for x in lossy.apply(r, contigs, spec).collect()}
        with monkeypatch.context() as m:
            m.setattr(tracks.with_counts, "__defaults__", (40, 8))
            m.setattr(tracks.build, "__defaults__", (40, 8))
            b = {x.rec_idx: x.qual for x in lossy.apply(r, contigs, spec, tile=16).collect()}
        assert a == b and len(a) == r.count()


@pytest.mark.parametrize("name,most", [("md_tag", 1), ("mismatch_pileup", 1), ("lossy_N40_D8", 1), ("lossy_R40X10_N40", 2), ("lossy_P", 2)])
def test_records_are_scanned_once_and_bases_stay(spark, name, most):
    """Once for the answer, and once more where all reads are piled up first."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("orders.parquet") <= most
    if name.startswith("lossy"):
        moved = [x for x in plan.splitlines() if "Exchange" in x]
        assert not any("ref_pos" in x and "rec_idx" in x for x in moved) and not any("read_pos" in x for x in moved)


def test_contigs_decide_whether_long_reads_are_looked_for(spark):
    r = _reads(spark, [(1, "a", 1, 50), (2, "a", 5, 90)])
    short = spark.createDataFrame([("a", "N" * 100)], "rname string, seq string")
    assert not pileup.has_longer(r, short, F.raise_error(F.lit("the reads were looked at")), 100)
    assert pileup.has_longer(r, short, F.col("n"), 80) and not pileup.has_longer(r, short, F.col("n"), 95)
    assert not pileup.has_longer(r.where("false"), short, F.col("n"), 10) and not pileup.has_longer(r, short.where("false"), F.col("n"), 10)
