"""CIGAR strings and arrays of (len, op)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "MIDNSHP=X"
READ_OPS, REF_OPS = "MIS=X", "MDN=X"


def parse(cigar: Column) -> Column:
    """Array of struct(len, op); `*` gives an empty array."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)), lambda e: F.struct(F.substring(e, F.lit(1), F.length(e) - 1).cast("int").alias("len"), F.substring(e, -1, 1).alias("op")))


def render(ops: Column) -> Column:
    return F.when(F.size(ops) == 0, "*").otherwise(F.array_join(F.transform(ops, lambda e: F.concat(e["len"].cast("string"), e["op"])), ""))


def encode(ops: Column) -> Column:
    """Integers len << 4 | op."""
    return F.transform(ops, lambda e: F.shiftleft(e["len"], 4) + F.position(e["op"], F.lit(OPS)) - 1)


def total(ops: Column, kinds: str) -> Column:
    """Length over the elements of some kinds."""
    return F.aggregate(F.filter(ops, lambda e: e["op"].isin(*kinds)), F.lit(0), lambda a, e: a + e["len"])


def ref_letters(cigar: Column) -> Column:
    """total() over REF_OPS of a CIGAR string, of which only those lengths are taken."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{REF_OPS}]"), F.lit(1)), F.lit(0), lambda a, e: a + e.cast("int"))


def alignment_end(pos: Column, cigar: Column) -> Column:
    """Last reference position that the read covers, 1-based; pos - 1 without reference-consuming elements."""
    return pos - 1 + ref_letters(cigar)


def merged(ops: Column) -> Column:
    """Neighbours of one kind become one element."""
    empty = F.array().cast("array<struct<len:int,op:string>>")

    def step(a, e):
        same = (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["op"] == e["op"])
        return F.when(same, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct((F.try_element_at(a, F.lit(-1))["len"] + e["len"]).alias("len"), e["op"].alias("op"))))).otherwise(F.concat(a, F.array(F.struct(e["len"].alias("len"), e["op"].alias("op")))))

    return F.aggregate(ops, empty, step)
