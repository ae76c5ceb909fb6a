"""Position masks: arrays of positions, read from two line formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_integers(line: Column, sep: str = " ") -> Column:
    """Positions of a line of integers, ascending and once each; an empty line is an empty mask."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.trim(line), sep), lambda x: x != ""), lambda x: x.cast("int"))))


def from_letters(line: Column, masked: str = "x") -> Column:
    """1-based positions of `x` in a line of `x` and `_`."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.length(line), F.lit(1))), lambda i: F.substring(line, i, F.lit(1)) == masked)


def detect(line: Column) -> Column:
    """`integers`, `letters` or `unknown`."""
    return F.when(line.rlike(r"^[0-9 ]*$"), "integers").when(line.rlike("^[x_]+$"), "letters").otherwise("unknown")


def render(mask: Column, masked: str = "x", clear: str = "_") -> Column:
    """Letters up to the last position."""
    top = F.coalesce(F.array_max(mask), F.lit(0))
    return F.when(top == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), lambda i: F.when(F.array_contains(mask, i), masked).otherwise(clear)), ""))


def describe(masks: DataFrame) -> DataFrame:
    """Number, first and last of each mask's positions, -1 if it is empty."""
    none = F.lit(-1)
    return masks.select("*", F.size("mask").alias("n"), F.coalesce(F.array_min("mask"), none).alias("first"), F.coalesce(F.array_max("mask"), none).alias("last"))
