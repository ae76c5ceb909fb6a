"""Joining files: records, headers, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.cuts import numbered


def merged(sources: dict[str, DataFrame]) -> DataFrame:
    """All records of all sources with names `source.name` and their `source`; order them by merge_order()."""
    return reduce(DataFrame.unionByName, (df.withColumns({"source": F.lit(k), "qname": F.concat(F.lit(k + "."), F.col("qname"))}) for k, df in sources.items()))


def _placed(reads: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, list]:
    """reads with the contig's place in the dictionary, and the order of merging."""
    return reads.join(dictionary.select("rname", "ref_id"), "rname", "left"), [F.col("ref_id").asc_nulls_last(), F.col("pos").asc(), F.col("source").asc(), F.col("rec_idx").asc()]


def merge_order(reads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Sorted by the contig's place in the dictionary, position, then source and input order; unplaced records last."""
    placed, order = _placed(reads, dictionary)
    return placed.orderBy(*order).drop("ref_id")


def merge_places(reads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each record with its place, 1 .. n, in the merged order."""
    placed, order = _placed(reads, dictionary)
    return numbered(placed, order).drop("ref_id")


def header_union(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each id."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def distinct_ids(sources: DataFrame, ident: str = "id", order: str = "i") -> DataFrame:
    """Ids that occur more than once get 1, 2, ... appended in order."""
    w = Window.partitionBy(ident)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    return sources.withColumn("unique_id", F.when(n > 1, F.concat(F.col(ident), i.cast("string"))).otherwise(F.col(ident)))


#: Bits of a record's number beside its mapping quality (a byte) in one long.
_NUMBER_BITS = 55


def best_of_name(reads: DataFrame) -> DataFrame:
    """One record for each name: the highest mapping quality, on a tie the first. A null quality counts as 0.

    Quality and number make one long, so a name's best record is one maximum, in hash tables before and after the shuffle; whole records are
    met by their number.
    """
    unit = 1 << _NUMBER_BITS
    quality = F.coalesce(F.col("mapq"), F.lit(0)).cast("long")
    top = reads.groupBy("qname").agg(F.max(quality * F.lit(unit) - F.col("rec_idx")).alias("top"))
    number = F.shiftright(F.col("top") + F.lit(unit - 1), _NUMBER_BITS) * F.lit(unit) - F.col("top")
    return reads.join(top.select(number.alias("rec_idx")), "rec_idx", "left_semi")
