"""Letters of many reads laid out at once, against reads walked one by one."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.operators import letters, pileup
from readloom.plans import catalog

SF = "/root/testdata/sf0.001"
CONTIG = "".join(random.Random(1).choice("ACGTacgtNß\U0001f9ec") for _ in range(400))


def some_reads(n: int, seed: int) -> list[tuple]:
    """Reads of all kinds of elements, some of no letters, some past the contig's end or longer than their bases, mostly with the contig's letters."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        cigar = "".join(f"{rng.choice([0, 1, 2, 7, 30])}{rng.choice('MMMM=XIDNSHP')}" for _ in range(rng.randint(1, 6))) if i % 17 else "*"
        pos, r, seq = rng.randint(1, 400), 0, ""
        for k, op in re.findall(r"(\d+)(.)", cigar):
            part = (CONTIG[pos - 1 + r :] + "T" * 200)[: int(k)]
            seq += part if op in "M=X" else "G" * int(k) if op in "IS" else ""
            r += int(k) if op in "MDN=X" else 0
        if i % 3 == 0 and seq:
            at = rng.randrange(len(seq))
            seq = seq[:at] + rng.choice("ACGTé") + seq[at + 1 :]
        rows.append((i, 0, "a", pos, cigar, seq[: len(seq) - (i % 11 == 0) * 3]))
    return rows


def walked(row: tuple) -> tuple[str, int, list[tuple]]:
    """MD, NM and the aligned letters (ref_pos, ref_base, base) of one read."""
    _, _, _, pos, cigar, seq = row
    md, run, nm, q, r, met = "", 0, 0, 0, pos - 1, []
    for n, op in re.findall(r"(\d+)(.)", cigar):
        n = int(n)
        if op in "M=X":
            for k in range(n):
                b, t = seq[q + k : q + k + 1], CONTIG[r + k : r + k + 1]
                met.append((r + k + 1, t, b))
                if t and b == t:
                    run += 1
                elif t:
                    md, run, nm = md + f"{run}{t}", 0, nm + 1
        elif op == "D" and (gone := CONTIG[r : r + n]):
            md, run, nm = md + f"{run}^{gone}", 0, nm + len(gone)
        elif op == "I":
            nm += n
        q, r = q + n * (op in "M=XIS"), r + n * (op in "M=XDN")
    return md + str(run), nm, met


@pytest.fixture(scope="module")
def tables(spark):
    rows = some_reads(700, 2)
    return rows, spark.createDataFrame(rows, "rec_idx long, flag int, rname string, pos int, cigar string, seq string"), spark.createDataFrame([("a", CONTIG)], "rname string, seq string")


def test_md_and_nm_equal_those_of_a_walk(tables):
    rows, reads, ref = tables
    want = {r[0]: walked(r)[:2] for r in rows}
    assert {x.rec_idx: (x.md, x.nm) for x in pileup.md_nm(reads, ref).collect()} == want
    assert {x.rec_idx: x.nm for x in pileup.md_nm(reads, ref, with_md=False).collect()} == {i: nm for i, (_, nm) in want.items()}


def test_a_read_without_cigar_or_bases_has_null_tags(spark, tables):
    reads = spark.createDataFrame([(1, 0, "a", 5, None, "AC"), (2, 0, "a", 5, "2M", None), (3, 0, "a", 5, "*", "AC"), (4, 4, "a", 5, "2M", "AC")], "rec_idx long, flag int, rname string, pos int, cigar string, seq string")
    assert sorted(map(tuple, pileup.md_nm(reads, tables[2]).collect())) == [(1, None, None), (2, None, None), (3, "0", 0)]


def test_letters_are_counted_beside_the_contig(tables):
    """Each read ten times over: as many rows as without, with ten times the number."""
    rows, reads, ref = tables
    want = Counter((r[0] % 2 == 0, *x) for r in rows for x in walked(r)[2])
    for times in (1, 10):
        many = reads.withColumns({"even": F.expr("rec_idx % 2 = 0"), "copy": F.explode(F.sequence(F.lit(1), F.lit(times)))}).coalesce(1)
        got = pileup.letter_counts(many, ref, "even").collect()
        assert len(got) == len(want)
        assert {(x.even, x.ref_pos, x.ref_base, x.base): x.n for x in got} == {k: n * times for k, n in want.items()}
    assert got[0].rname == "a"


def test_counts_of_places_far_apart():
    """Places too far apart for one number with their group and letters."""
    t = pa.table({"cigar": ["2M"] * 3, "seq": ["\U0001f9ec" + "A", "AC", "AC"], "stretch": ["AC", "AC", "AC"]})
    many = pa.table({c: pa.concat_arrays([t[c].combine_chunks()] + [pa.array(["".join(map(chr, range(1000, 4000)))] if c != "cigar" else ["3000M"])]) for c in t.column_names})
    group, n = letters.Laid(many).counts(np.array([0, 1, 1 << 12, 1 << 12]), np.array([1, (1 << 31) - 10, 1, 5000]))
    got = Counter(zip(group.tolist(), *(n[c].to_pylist() for c in ("ref_pos", "ref_base", "base")), strict=True))
    assert set(n["n"].to_pylist()) == {1} and len(got) == 3006
    assert {x for x in got if x[1] < 5000 and x[0] < 1 << 12 or x[1] > 8000} == {(0, 1, "A", "\U0001f9ec"), (0, 2, "C", "A"), (1, (1 << 31) - 10, "A", "A"), (1, (1 << 31) - 9, "C", "C")}


@pytest.mark.parametrize("name", ["keep_positions", "base_counts"])
def test_no_row_is_made_of_a_letter(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence(1, e" not in plan and "explode(sequence(1, len" not in plan


@pytest.mark.parametrize("at_once", [1, 50, 1000, 1 << 20])
def test_rows_are_dealt_whole_and_in_order(at_once):
    rng = random.Random(4)
    texts = [rng.choice([None, "", "A", "C" * 40, "G" * 300]) for _ in range(500)]
    batches = [pa.record_batch({"i": list(range(a, min(a + k, 500))), **{c: pa.array(texts[a : a + k], pa.string()) for c in ("cigar", "seq", "stretch")}}) for a, k in [(0, 1), (1, 0), (1, 250), (251, 249)]]
    out = list(letters.dealt(iter(batches), at_once))
    assert [i for t in out for i in t["i"].to_pylist()] == list(range(500))
    size = [sum(3 * len(x or "") for x in t["seq"].to_pylist()) for t in out]
    assert all(n <= at_once or sum(bool(x) for x in t["seq"].to_pylist()) == 1 for n, t in zip(size, out, strict=True))


@pytest.mark.parametrize("name", ["nm_tag", "md_tag"])
def test_no_letter_is_walked_by_an_expression(spark, name):
    """A fold over an element's letters cost more than all else at 9 million reads."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "sequence(1, length" not in plan
