"""Filters on records."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.flags import has

OPEN_END = (1 << 31) - 1


def required_any(reads: DataFrame, bits: int) -> DataFrame:
    """Reads with any of the bits; 0 asks for nothing."""
    return reads if bits == 0 else reads.where(has(F.col("flag"), bits))


def required_all(reads: DataFrame, bits: int) -> DataFrame:
    return reads.where(F.col("flag").bitwiseAND(F.lit(bits)) == bits)


def excluded(reads: DataFrame, bits: int) -> DataFrame:
    """Reads with none of the bits."""
    return reads.where(~has(F.col("flag"), bits))


@dataclass(frozen=True)
class Region:
    """seq[:start[-end]], 1-based, both ends included; an end of 0 or none is open."""

    name: str
    start: int = 0
    end: int = OPEN_END

    @classmethod
    def parse(cls, spec: str) -> Region:
        m = re.fullmatch(r"([^:]+)(?::(\d+)(?:-(\d+))?)?", spec.replace(",", ""))
        if not m:
            raise ValueError(f"not a region: {spec!r}")
        return cls(m[1], int(m[2] or 0), int(m[3] or 0) or OPEN_END)

    def __str__(self) -> str:
        return self.name + (f":{self.start}" + (f"-{self.end}" if self.end != OPEN_END else "") if self.start or self.end != OPEN_END else "")

    def test(self, how: str = "overlapping") -> Column:
        """overlapping, contained or starting_at; a placed read without an extent counts at its start. The name `*` asks for unplaced reads."""
        if self.name == "*":
            return F.col("rname") == "*"
        # plain comparisons, which reach the scan: the end of a read is the greater one of both columns
        pos, end = F.col("pos"), F.col("aln_end")
        where = {
            "overlapping": (pos <= self.end) & ((end >= self.start) | (pos >= self.start)),
            "contained": (pos >= self.start) & (pos <= self.end) & ((end <= self.end) | end.isNull()),
            "starting_at": pos == self.start,
        }[how]
        return (F.col("rname") == self.name) & where


def in_region(reads: DataFrame, spec: str, how: str = "overlapping") -> DataFrame:
    return reads.where(Region.parse(spec).test(how))


def in_regions(reads: DataFrame, specs: list[str], how: str = "overlapping") -> DataFrame:
    """One result for each region, put together: a read that lies in two regions comes twice. One pass over the reads."""
    tests = [Region.parse(s).test(how) for s in specs]
    hits = F.array(*(F.when(t, F.lit(i)) for i, t in enumerate(tests)))
    return reads.where(any_of(tests) if tests else F.lit(False)).withColumn("region", F.explode(F.filter(hits, lambda x: x.isNotNull())))


def unmapped(reads: DataFrame) -> DataFrame:
    return reads.where(has(F.col("flag"), 4))


def primary(reads: DataFrame) -> DataFrame:
    """Neither secondary nor supplementary."""
    return excluded(reads, 2304)


def mapq_below(reads: DataFrame, n: int) -> DataFrame:
    return reads.where(F.col("mapq") < n)


def mapq_above(reads: DataFrame, n: int) -> DataFrame:
    return reads.where(F.col("mapq") > n)


def with_mask(reads: DataFrame, pos: str = "pos", mask: str = "mask") -> DataFrame:
    """Whether a position is in an array of masked positions."""
    return reads.withColumn("is_masked", F.array_contains(mask, F.col(pos)))


def name_lookup(dictionary: DataFrame, name: str) -> DataFrame:
    """Contigs that have a word beginning with name: of those the one that itself begins with it, else the first."""
    hit = dictionary.where(F.col("rname").rlike(rf"\b{re.escape(name)}.*\b"))
    return hit.orderBy(F.col("rname").startswith(name).desc(), "ref_id").limit(1)


def validation_summary(reads: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Counts of records that break a rule, by rule."""
    rules = {
        "mapq_of_unmapped": has(F.col("flag"), 4) & (F.col("mapq") != 0), "unmapped_with_cigar": has(F.col("flag"), 4) & (F.col("cigar") != "*"), "mapped_without_position": ~has(F.col("flag"), 4) & (F.col("pos") < 1),
        "first_and_second": has(F.col("flag"), 64) & has(F.col("flag"), 128), "lengths_differ": F.length("seq") != F.length("qual"), "pair_bits_without_pair": ~has(F.col("flag"), 1) & has(F.col("flag"), 2 | 8 | 32 | 64 | 128),
    }
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items() if n not in ignore)))
    return reads.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def validation_with_reference(reads: DataFrame, ref: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """validation_summary() with the rules that need the contigs, the CIGAR or the mate: CIGARs that don't fit their bases, contigs that ref lacks, alignments beyond their contig, and pairs whose flags don't agree. One row for each rule that is broken."""
    from readloom.functions import cigar
    from readloom.operators import pairing

    placed = ~has(F.col("flag"), 4)
    lengths = ref.select("rname", F.length("seq").alias("__length"))  # a row for each contig
    r = reads.where(placed).join(lengths, "rname", "left")
    fits = cigar.total(cigar.parse(F.col("cigar")), cigar.READ_OPS) == F.length("seq")
    rules = {"cigar_length_differs": (F.col("cigar") != "*") & (F.col("seq") != "*") & ~fits, "unknown_contig": F.col("__length").isNull(), "beyond_contig": F.col("aln_end") > F.col("__length")}
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items() if n not in ignore)))
    out = validation_summary(reads, ignore).unionByName(r.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n")))
    if "mates_disagree" in ignore:
        return out
    pairs = pairing.flag_check(reads).where("not consistent").agg(F.lit("mates_disagree").alias("rule"), F.count("*").alias("n")).where("n > 0")
    return out.unionByName(pairs)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
