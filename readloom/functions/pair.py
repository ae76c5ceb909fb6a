"""Insert sizes and mate checks of two records, as Columns. Arguments are structs with flag, rname, pos and aln_end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.flags import has


def _placed(a: Column, b: Column) -> Column:
    return ~has(a["flag"], 4) & ~has(b["flag"], 4) & (a["rname"] == b["rname"])


def five_prime_size(a: Column, b: Column) -> Column:
    """Distance of a's 5' end to b's, counting both; 0 if either is unmapped or the contigs differ."""
    end = lambda r: F.when(has(r["flag"], 16), r["aln_end"]).otherwise(r["pos"])
    d = end(b) - end(a)
    return F.when(_placed(a, b), d + F.when(d >= 0, 1).otherwise(-1)).otherwise(0)


def outer_size(a: Column, b: Column) -> Column:
    """Extent of both alignments, positive for the leftmost record (on a tie: the first of the pair); 0 as above."""
    size = F.greatest(a["aln_end"], b["aln_end"]) - F.least(a["pos"], b["pos"]) + 1
    left = F.when(a["pos"] != b["pos"], a["pos"] < b["pos"]).otherwise(has(a["flag"], 64))
    return F.when(_placed(a, b), F.when(left, size).otherwise(-size)).otherwise(0)


def flags_agree(a: Column, b: Column) -> Column:
    """Both paired, what each says of its mate holds, proper pair alike, and not both first or both second."""
    f, g = a["flag"], b["flag"]
    return (
        has(f, 1) & has(g, 1) & (has(f, 8) == has(g, 4)) & (has(g, 8) == has(f, 4)) & (has(f, 32) == has(g, 16)) & (has(g, 32) == has(f, 16))
        & (has(f, 2) == has(g, 2)) & ~(has(f, 64) & has(g, 64)) & ~(has(f, 128) & has(g, 128))
    )
