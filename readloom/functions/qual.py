"""Quality scores: text is Phred + 33."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 93


def illumina_bin(q: int) -> int:
    """Eight-level binning."""
    for low, value in ((40, 40), (35, 37), (30, 33), (25, 27), (20, 22), (10, 15), (2, 6)):
        if q >= low:
            return value
    return q


def ncbi_bin(q: int) -> int:
    for low, value in ((30, 35), (25, 28), (20, 22), (15, 17), (3, 9)):
        if q >= low:
            return value
    return q


#: Scores that a binned file can hold.
ILLUMINA_VALUES = (0, 1, 6, 15, 22, 27, 33, 37, 40)


def binned(qual: Column, rule: Callable[[int], int] = illumina_bin) -> Column:
    """All scores of a read replaced by their bin, in one pass of translate()."""
    return F.translate(qual, "".join(chr(q + 33) for q in range(TOP + 1)), "".join(chr(rule(q) + 33) for q in range(TOP + 1)))


def binned_score(q: Column, rule: Callable[[int], int] = illumina_bin) -> Column:
    """One numeric score replaced by its bin; larger than 93 counts as 93."""
    table = F.array(*(F.lit(rule(i)) for i in range(TOP + 1)))
    return F.element_at(table, F.least(q, F.lit(TOP)).cast("int") + 1)


def to_scores(qual: Column) -> Column:
    return F.transform(F.filter(F.split(qual, ""), lambda x: x != ""), lambda x: F.ascii(x) - 33)


def from_scores(scores: Column, default: int = 30) -> Column:
    """Text of an array of scores; a score below 0 counts as missing and takes the default."""
    return F.array_join(F.transform(scores, lambda q: F.char(F.when(q < 0, default).otherwise(q) + 33)), "")
