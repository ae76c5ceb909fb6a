"""Flag bits as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.schema import FLAGS


def has(flag: Column, bits: int) -> Column:
    """Any of the bits is set."""
    return flag.bitwiseAND(F.lit(bits)) != 0


def decode(flag: Column) -> list[Column]:
    return [has(flag, b).alias(f"is_{n}") for n, b in FLAGS.items()]


def segment(flag: Column) -> Column:
    """0 for a read without a pair, 1 for the first of a pair, else 2."""
    return F.when(~has(flag, FLAGS["paired"]), 0).when(has(flag, FLAGS["first"]), 1).otherwise(2)


def stream_index(flag: Column) -> Column:
    """As segment(), but a paired read with neither bit goes to 0."""
    return F.when(~has(flag, FLAGS["paired"]), 0).when(has(flag, FLAGS["first"]), 1).when(has(flag, FLAGS["second"]), 2).otherwise(0)
