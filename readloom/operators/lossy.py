"""Lossy quality scores: a small language compiled to Columns.

A specification is policies joined by `-`. A policy: `R` bases that match the contig, `N` bases that don't, `X<n>` bases
covered by less than n reads, `D` the two bases after a deletion, `I` inserted bases, `P<n>` positions with more than n
mismatches, `M<n>`/`m<n>` reads with mapping quality above/below n, `U` unmapped reads, `*` every read, `_` a treatment
alone. A number after R, N, D, I, P, U, `*`, `_` (for M and m after another `_`) is the treatment: none or 0 drops the score, 40 keeps it,
any other number bins it. Policies are applied in order of treatment so that keeping wins over binning, and binning over dropping.

Where text and long practice of this language disagree the practice is followed: match and mismatch also look at
inserted and clipped bases, `D` marks the bases after the deletion, and in one policy of several categories a coverage test
overrides the tests before it on aligned bases.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import cigar, qual
from readloom.functions.flags import has
from readloom.operators import pileup, tracks

DROP, BIN, KEEP = 0, 1, 2
DEFAULT = 30


def treatment(number: str | None) -> int:
    n = int(number or 0)
    return KEEP if n == 40 else BIN if n else DROP


@dataclass
class Policy:
    """One word: a test of the read (None: any), tests of a base, and what is done."""

    read: tuple[str, int] | None = None
    bases: list[tuple[str, int]] = field(default_factory=list)
    treat: int = KEEP

    def __str__(self) -> str:
        name = {DROP: "drop", BIN: "bin", KEEP: "preserve"}[self.treat]
        tests = ([f"reads {self.read[0]}{self.read[1] or ''}"] if self.read else []) + [f"bases {k}{n or ''}" for k, n in self.bases]
        return f"{name} scores of " + (" and ".join(tests) or "all reads")


def parse(spec: str) -> list[Policy]:
    """Policies in the order in which they are applied."""
    out = []
    for word in filter(None, spec.split("-")):
        p, at = Policy(), 0
        for m in re.finditer(r"([A-Za-z_*])(\d*)", word):
            if m.start() != at:
                break
            at, code, number = m.end(), m[1], m[2]
            if code in "RNDI":
                p.bases.append((code, 0))
                p.treat = treatment(number)
            elif code in "XP":
                p.bases.append((code, int(number or 0)))
                p.treat = p.treat if code == "X" else DROP  # all digits are the limit; `_` names a treatment
            elif code in "Mm":
                p.read = (code, int(number or 0))
            elif code in "U*":
                p.read = (code, 0)
                p.treat = treatment(number)
            elif code == "_":
                p.treat = treatment(number)
            else:
                raise ValueError(f"unknown category {code!r} in {word!r}")
        if at != len(word):
            raise ValueError(f"not a policy: {word!r}")
        out.append(p)
    return sorted(out, key=lambda p: p.treat)


def needs_pileup(policies: list[Policy]) -> bool:
    return any(k in "XP" for p in policies for k, _ in p.bases)


def is_lossless(policies: list[Policy] | None) -> bool:
    """None: nothing is changed. An empty list drops all scores."""
    return policies is None or (bool(policies) and all(p.treat == KEEP and not p.bases and (p.read or ("*", 0))[0] == "*" for p in policies))


def _read_test(p: Policy) -> Column:
    kind, n = p.read or ("*", 0)
    return {"*": F.lit(True), "U": has(F.col("flag"), 4), "M": F.col("mapq") > n, "m": F.col("mapq") < n}[kind]


#: Fields of a base, in order, with their types.
_FIELDS = {"read_pos": "int", "op": "string", "ref_pos": "int", "base": "string", "ref_base": "string", "after_deletion": "boolean", "score": "int", "coverage": "int", "mismatches": "int"}


def with_bases(reads: DataFrame, ref: DataFrame, tile: int = pileup.TILE, fields: tuple[str, ...] = tuple(_FIELDS)[:7], how: str = "inner", wanted: Column | None = None) -> DataFrame:
    """Placed reads with `bases`, an array of each base's read_pos, op, ref_pos, base, ref_base (the contig's base at the position that the read has reached, also at insertions and clips), after_deletion and score.

    fields: only these are made; coverage and mismatches need columns of these names, counts of the positions from pos on.
    how: "left" keeps unplaced reads and those of other contigs, with null bases. wanted: with it, reads for which it does not hold have null bases too.
    """
    placed = F.col("flag").bitwiseAND(4) == 0
    whole = pileup.with_stretch(reads.where(placed) if how == "inner" else reads, ref, tile, how)
    if "after_deletion" in fields:
        whole = whole.withColumn("gone", _deletions())
    fields = tuple(f for f in _FIELDS if f in fields)
    start = F.struct(F.array().cast(f"array<struct<{','.join(f'{f}:{_FIELDS[f]}' for f in fields)}>>").alias("done"), F.lit(0).alias("q"), F.lit(0).alias("r"))

    def step(a, e):
        takes_q, takes_r = e["op"].isin(*cigar.READ_OPS), e["op"].isin(*cigar.REF_OPS)

        def one(k):
            at = a["q"] + k
            # the array is named twice, so Spark doesn't put its making into this function of each base
            count = lambda name, i: F.when(F.size(F.col(name)) >= i, F.coalesce(F.try_element_at(F.col(name), F.greatest(i, F.lit(1))), F.lit(0))).otherwise(0)
            made = {
                "read_pos": lambda: at, "op": lambda: e["op"], "ref_pos": lambda: (F.col("pos") + a["r"] + k - 1).cast("int"), "base": lambda: F.substring(F.col("seq"), at, F.lit(1)),
                "ref_base": lambda: F.substring(F.col("stretch"), a["r"] + k, F.lit(1)), "after_deletion": lambda: F.array_contains("gone", at - 1) | F.array_contains("gone", at - 2),
                "score": lambda: F.ascii(F.substring(F.col("qual"), at, F.lit(1))) - 33, "coverage": lambda: count("coverage", a["r"] + k), "mismatches": lambda: count("mismatches", at),
            }
            return F.struct(*(made[f]().alias(f) for f in fields))

        done = F.when(takes_q & (e["len"] > 0), F.concat(a["done"], F.transform(F.sequence(F.lit(1), e["len"]), one))).otherwise(a["done"])
        return F.struct(done.alias("done"), (a["q"] + F.when(takes_q, e["len"]).otherwise(0)).alias("q"), (a["r"] + F.when(takes_r, e["len"]).otherwise(0)).alias("r"))

    bases = F.aggregate(cigar.parse(F.col("cigar")), start, step, lambda a: a["done"])
    if how == "left":
        bases = F.when(placed & F.col("stretch").isNotNull() & (F.lit(True) if wanted is None else wanted), bases)
    return whole.withColumn("bases", bases).drop("gone", "stretch")


def base_table(reads: DataFrame, ref: DataFrame, tile: int = pileup.TILE) -> DataFrame:
    """The bases of with_bases(), one in a row, with rec_idx, flag, rname, mapq and pos."""
    return with_bases(reads, ref, tile).select("rec_idx", "flag", "rname", "mapq", "pos", F.explode("bases").alias("b")).select("rec_idx", "flag", "rname", "mapq", "pos", "b.*")


def _deletions() -> Column:
    """Numbers of read bases before each deletion."""
    start = F.struct(F.array().cast("array<int>").alias("gone"), F.lit(0).alias("q"))

    def step(a, e):
        gone = F.when(e["op"] == "D", F.concat(a["gone"], F.array(a["q"]))).otherwise(a["gone"])
        return F.struct(gone.alias("gone"), (a["q"] + F.when(e["op"].isin(*cigar.READ_OPS), e["len"]).otherwise(0)).alias("q"))

    return F.aggregate(cigar.parse(F.col("cigar")), start, step, lambda a: a["gone"])


def _base_test(p: Policy, get=F.col) -> Column:
    """Tests of one policy in turn: each replaces the outcome where it applies. get: gives a column of a base."""
    hit = F.lit(False)
    for kind, n in p.bases:
        if kind == "R":
            hit = get("base") == get("ref_base")
        elif kind == "N":
            hit = get("base") != get("ref_base")
        elif kind == "D":
            hit = hit | get("after_deletion")
        elif kind == "I":
            hit = hit | (get("op") == "I")
        elif kind == "X":
            hit = F.when(get("op").isin("M", "=", "X"), F.coalesce(get("coverage"), F.lit(0)) < n).otherwise(hit)
        else:
            hit = hit | (F.coalesce(get("mismatches"), F.lit(0)) > n)
    return hit


def _stored(policies: list[Policy], get=F.col) -> Column:
    """The score that the policies store for a base; null where none does."""
    stored = F.lit(None).cast("int")
    for p in policies:
        made = {KEEP: get("score"), BIN: qual.binned_score(get("score")), DROP: F.lit(None).cast("int")}[p.treat]
        stored = F.when(_base_test(p, get) & _read_test(p), made).otherwise(stored)
    return stored


def _may_hit(p: Policy) -> Column:
    """Whether a policy may store a score of a read: one that asks for insertions or deletions alone needs a read with such."""
    kinds = {k for k, _ in p.bases}
    held = [F.contains("cigar", F.lit(k)) for k in sorted(kinds)] if kinds <= {"I", "D"} else [F.lit(True)]
    return functools.reduce(lambda x, y: x | y, held) & _read_test(p)


_NEEDS = {"R": ("base", "ref_base"), "N": ("base", "ref_base"), "D": ("after_deletion",), "I": ("op",), "X": ("op", "coverage"), "P": ("mismatches",)}


def apply(reads: DataFrame, ref: DataFrame, spec: str, tile: int = pileup.TILE) -> DataFrame:
    """rec_idx and qual: the scores that a file written by the specification gives back.

    A score that nothing keeps becomes the default, 30. Each read's scores are made within its row, of the fields that the policies ask
    for. Pileups are made only if a policy asks for them, over all reads; they come to the reads as tracks (see tracks.py), so no base is
    shuffled.
    """
    policies = parse(spec)
    whole = F.lit(None).cast("string")
    for p in policies:
        if not p.bases:
            made = {KEEP: F.col("qual"), BIN: qual.binned(F.col("qual")), DROP: F.lit(None).cast("string")}[p.treat]
            whole = F.when(_read_test(p), made).otherwise(whole)
    by_base = [p for p in policies if p.bases]
    base = F.coalesce(whole, F.expr(f"repeat('{chr(DEFAULT + 33)}', length(qual))"))
    if not by_base:
        return reads.select("rec_idx", base.alias("qual"))
    asked = {k for p in by_base for k, _ in p.bases}
    r = reads.withColumn("plain", base)
    if "X" in asked:
        span = cigar.total(cigar.parse(F.col("cigar")), cigar.REF_OPS)
        most = max(n for p in by_base for k, n in p.bases if k == "X")  # no test tells larger counts apart
        r = tracks.with_counts(r, tracks.build(tracks.capped(pileup.coverage_runs(reads), most)), ref, F.col("pos") + span - 1, "coverage")
    if "P" in asked:
        seen = pileup.mismatches(reads, ref, tile).select("rname", F.col("ref_pos").alias("begin"), (F.col("ref_pos") + 1).alias("stop"), F.col("mismatches").alias("n"))
        most = max(n for p in by_base for k, n in p.bases if k == "P") + 1
        r = tracks.with_counts(r, tracks.build(tracks.capped(seen, most)), ref, F.col("pos") + F.length("seq") - 1, "mismatches")
    fields = {"read_pos", *(["score"] if any(p.treat != DROP for p in by_base) else []), *(f for k in asked for f in _NEEDS[k])}
    plain = lambda i: F.ascii(F.substring(F.col("plain"), i, F.lit(1))) - 33
    done = F.transform("bases", lambda x: F.char(F.coalesce(_stored(by_base, lambda n: x[n]), plain(x["read_pos"])) + 33))
    # reads that no policy can touch keep their plain scores as they are, if these are as many as their bases at least
    touched = functools.reduce(lambda x, y: x | y, map(_may_hit, by_base))
    wanted = touched | (F.length("plain") < cigar.total(cigar.parse(F.col("cigar")), cigar.READ_OPS))
    # a score string longer than its read's bases keeps its tail
    mixed = F.concat(F.array_join(done, ""), F.expr("substring(plain, size(bases) + 1)"))
    return with_bases(r, ref, tile, tuple(fields), "left", wanted).select("rec_idx", F.when(F.col("bases").isNull(), F.col("plain")).otherwise(mixed).alias("qual"))


def stored_whole(reads: DataFrame, ref: DataFrame, spec: str) -> DataFrame:
    """rec_idx, kept, whole: the number of bases that some policy keeps, and whether that is more than half the read, so that its scores are stored as one string and not one by one. For specifications without pileup."""
    policies = parse(spec)
    if needs_pileup(policies):
        raise ValueError("pileup categories can't be counted within a read")
    def hit(x):
        out = F.lit(False)
        for p in policies:
            if p.bases:
                out = out | (_base_test(p, lambda n: x[n]) & _read_test(p))
        return out

    bases = with_bases(reads, ref).withColumn("kept", F.size(F.filter("bases", hit)).cast("long"))
    return bases.select("rec_idx", "kept", (F.col("kept") > F.floor(F.size("bases") / 2)).alias("whole"))


def score_differences(a: DataFrame, b: DataFrame, ref: DataFrame) -> DataFrame:
    """rec_idx, read_pos, op, base, ref_base, score_a, score_b of bases whose scores differ; records must have equal CIGARs."""
    both = a.join(b.select("rec_idx", F.col("cigar").alias("cigar_b"), F.col("qual").alias("qual_b")), "rec_idx")
    unequal = F.when(F.col("cigar") == F.col("cigar_b"), ~F.col("qual").eqNullSafe(F.col("qual_b"))).otherwise(F.raise_error(F.concat(F.lit("CIGARs differ at record "), F.col("rec_idx").cast("string"))).cast("boolean"))
    # scores are held against each other within the row: only reads that differ meet the contig, and only bases that differ leave their read
    whole = with_bases(both.where(F.col("flag").bitwiseAND(4) == 0).where(unequal), ref)
    other = lambda x: F.ascii(F.substring(F.col("qual_b"), x["read_pos"], F.lit(1))) - 33
    found = F.transform(F.filter("bases", lambda x: x["score"] != other(x)), lambda x: F.struct(x.alias("b"), other(x).alias("score_b")))
    out = whole.select("rec_idx", "flag", "mapq", F.explode(found).alias("d"))
    return out.select("rec_idx", "flag", "mapq", "d.b.read_pos", "d.b.op", "d.b.base", "d.b.ref_base", "d.b.after_deletion", F.col("d.b.score").alias("score_a"), "d.score_b")


def obeys(differences: DataFrame, spec: str) -> DataFrame:
    """`obeys`: whether the second score is what the first applicable policy (the last applied) makes of the first one; where none applies, whether it is the default. For specifications without pileup."""
    policies = parse(spec)
    if needs_pileup(policies):
        raise ValueError("pileup categories can't be checked from differences alone")
    want = F.lit(DEFAULT)
    for p in policies:
        made = {KEEP: F.col("score_a"), BIN: qual.binned_score(F.col("score_a")), DROP: F.lit(DEFAULT)}[p.treat]
        want = F.when((_base_test(p) if p.bases else F.lit(True)) & _read_test(p), made).otherwise(want)
    return differences.withColumn("obeys", want == F.col("score_b"))
