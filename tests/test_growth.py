"""What keeps work in proportion to the records: shares of names, cuts of contigs, capped tracks, differences within the row."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from readloom.operators import cuts, lossy, pileup, tracks
from readloom.plans import catalog
from readloom.plans.fixtures import reads, ref
from readloom.sources import bai, bam
from readloom.streaming import collate
from tests import oracle

SF = "/root/testdata/sf0.001"


def test_pair_stream_holds_shares_not_names(spark):
    """Names with one to four records, in four files; state is a row for each share."""
    rng, big = random.Random(5), 1 << 60
    names = [f"n{i}" for i in range(3000) for _ in range(rng.choice([1, 2, 2, 2, 3, 4]))]
    rng.shuffle(names)
    rows = [(n, big + i) for i, n in enumerate(names)]
    t = spark.createDataFrame(rows, "qname string, rec_idx long").withColumn("ts", F.timestamp_seconds(F.lit(1.7e9) + (F.col("rec_idx") - big)))
    held = []
    out = collate.replay(spark, t, lambda s: collate.pair_stream(s, "30 days", 16), "append", ordered=True, seen=lambda q: held.extend(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress))
    of: dict = {}
    for n, i in rows:
        of.setdefault(n, []).append(i)
    want = {(n, i[k], i[k + 1] if k + 1 < len(i) else -1) for n, i in of.items() for k in range(0, len(i), 2)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert 0 < max(held) <= 16


def test_dedup_stream_holds_shares_not_names(spark):
    """Names with records at random times, some with null qualities or numbers, in four files; state is a row for each share."""
    rng, big = random.Random(6), 1 << 60
    rows = [(rng.choice([f"n{rng.randrange(600)}", None]) if i % 50 == 0 else f"n{rng.randrange(600)}", big + i, rng.choice([0, 5, 5, 9, None])) for i in range(3000)]
    t = spark.createDataFrame(rows, "qname string, rec_idx long, mapq int").withColumn("ts", F.timestamp_seconds(F.lit(1.7e9) + (F.col("rec_idx") - big)))
    held = []
    out = collate.replay(spark, t, lambda s: collate.dedup_stream(s, "300 seconds", 16), "append", ordered=True, seen=lambda q: held.extend(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress))
    of: dict = {}
    for n, i, q in rows:
        sessions = of.setdefault(n, [])
        if sessions and i - sessions[-1][-1][1] <= 300:
            sessions[-1].append((n, i, q))
        else:
            sessions.append([(n, i, q)])
    want = [max(x, key=lambda r: (-1 if r[2] is None else r[2], -r[1])) for sessions in of.values() for x in sessions]
    got = [tuple(r) for r in out.where("rec_idx is not null").collect()]
    assert len(got) == len(want) and set(got) == set(want)
    assert out.schema.simpleString() == "struct<qname:string,rec_idx:bigint,mapq:int>"
    assert 0 < max(held) <= 16


def test_files_come_in_the_order_of_their_ranges(spark):
    """The first range is the last one written; were it read last, its records would be too late for the watermark."""
    def slow(k: int) -> int:
        if k == 0:
            time.sleep(3)
        return k

    t = spark.range(400).select(F.udf(slow, "long")("id").alias("rec_idx")).withColumns({"qname": F.concat(F.lit("n"), "rec_idx"), "mapq": F.lit(1), "ts": F.timestamp_seconds(F.lit(1.7e9) + F.col("rec_idx") * 1000)})
    out = collate.replay(spark, t, lambda s: collate.dedup_stream(s, "1 minute"), "append").where("qname is not null")
    assert sorted(r.rec_idx for r in out.collect()) == list(range(400))


def test_scores_are_compared_within_the_row(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["score_diff"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any("read_pos" in x for x in plan.splitlines() if "Exchange" in x)


def test_score_differences_of_unequal_cigars_fail(spark):
    r = reads(spark, SF).where("rec_idx < 50")
    other = r.withColumn("cigar", F.expr("if(rec_idx = 10, '31M1S', cigar)"))
    with pytest.raises(Exception, match="CIGARs differ at record 10"):
        lossy.score_differences(r, other, ref(spark, SF)).collect()


@pytest.mark.parametrize("letters", [0, 4_000_000])
@pytest.mark.parametrize("tile", [100, 1000])
def test_stretches_at_the_edges_of_cuts(spark, monkeypatch, letters, tile):
    monkeypatch.setattr(pileup, "BROADCAST_LETTERS", letters)
    monkeypatch.setattr(pileup, "CUT", 16)
    rng = random.Random(tile)
    seq = "".join(rng.choice("ACGT") for _ in range(1203))
    rows = [(i, "a" if i % 9 else "none", rng.randint(1, 1210), f"{n}M", "N" * 3) for i, n in enumerate(rng.choice([1, 5, 12, 13, 14, 40, 150]) for _ in range(300))]
    r = spark.createDataFrame(rows, "rec_idx long, rname string, pos int, cigar string, seq string")
    got = {x.rec_idx: x.stretch for x in pileup.with_stretch(r, spark.createDataFrame([("a", seq)], "rname string, seq string"), tile, "left").collect()}
    assert got == {i: seq[p - 1 : p - 1 + int(c[:-1]) + 3] if n == "a" else None for i, n, p, c, _ in rows}


def test_capped_runs_tell_the_same_counts_apart(spark):
    rng, at, rows = random.Random(3), 1, []
    for _ in range(400):
        at += rng.choice([0, 0, 0, 2])
        n = rng.choice([1, 3, 30])
        rows.append(("a", at, at + n, rng.randint(1, 9)))
        at += n
    got = tracks.capped(spark.createDataFrame(rows, "rname string, begin int, stop int, n int"), 4, 1000).collect()
    spread = lambda runs: {p: min(n, 4) for _, b, e, n in runs for p in range(b, e)}
    assert spread(got) == spread(rows) and sum(e - b for _, b, e, _ in got) == len(spread(rows)) and len(got) < len(rows)


@pytest.mark.parametrize("spec", ["U40-I8", "D40-I8", "M20_8-I40", "I40-m5", "R8-D40"])
def test_only_reads_that_a_policy_can_touch_are_taken_apart(spark, monkeypatch, spec):
    """Scores are the same as with every read taken apart; among the reads there are scores shorter than the bases."""
    r, s = reads(spark, SF).withColumn("qual", F.expr("if(rec_idx % 10 = 3, '*', qual)")), ref(spark, SF)
    made = []
    whole = lossy.with_bases
    monkeypatch.setattr(lossy, "with_bases", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    got = sorted(map(tuple, lossy.apply(r, s, spec).collect()))
    if spec == "U40-I8":
        assert made[0].where("bases is not null and not contains(cigar, 'I') and qual <> '*'").isEmpty()
    monkeypatch.setattr(lossy, "_may_hit", lambda p: F.lit(True), raising=False)
    assert got == sorted(map(tuple, lossy.apply(r, s, spec).collect()))


def test_files_of_the_index_grow_in_number(spark, monkeypatch):
    """Records are shuffled once, into files of so many each, and nothing of them is written to the shared folder."""
    made, whole = [], bam.to_bam
    monkeypatch.setattr(bam, "RECORDS", 100, raising=False)
    monkeypatch.setattr(bam, "to_bam", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    monkeypatch.setattr(cuts, "cut", lambda df: pytest.fail("records were written to the shared folder"))
    got = oracle.spark_rows(catalog.QUERIES["bai_round_trip"](spark, SF))
    assert got == oracle.duck_rows(oracle.duck(SF), catalog.SQL["bai_round_trip"])
    n = reads(spark, SF).count()
    last = (-1, 0, 0)  # the files follow one another in order of place
    sizes = []
    for x in made[0].orderBy("part").collect():
        _, refs, _ = bam.header(bam.inflate(bytes(x.content)))
        number = bam.numbers(refs)
        places = [(r[2] == "*", number[r[2]], r[3]) for r in bam.records(bam.inflate(bytes(x.content)))]
        assert places == sorted(places) and places[0] >= last
        last = places[-1]
        sizes.append(len(places))
    assert sum(sizes) == n and max(sizes) <= 400 and len(sizes) >= n // 200


def test_index_rows_are_met_once(spark):
    """A file's index is made of one pass over its index rows, as what makes them is the work."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("a", "chunk", 0, 4681, 100, 200), ("a", "line", 0, 0, 100, 0), ("a", "span", 0, 0, 100, 200), ("a", "count", 0, 0, 3, 1), ("a", "loose", -1, 0, 2, 0), ("a", "loose", -1, 0, 5, 0), ("a", "refs", -1, 0, 3, 0)]
    got = bai.to_bai(spark.createDataFrame(rows, bai.INDEX).coalesce(1).mapInArrow(run, bai.INDEX)).collect()
    want = [("chunk", 0, 4681, 100, 200), ("span", 0, 0, 100, 200), ("count", 0, 0, 3, 1), ("line", 0, 0, 100, 0), ("loose", -1, 0, 7, 0), ("refs", -1, 0, 3, 0)]
    assert [x.path for x in got] == ["a"] and bai.parse(bytes(got[0].content)) == want
    assert seen.value == len(rows)
