"""Comparing two files record by record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual")


def _differs(field: str, a: Column, b: Column, flag_mask: int, tlen_by: int) -> Column:
    if field == "flag" and flag_mask:
        return a.bitwiseAND(F.lit(~flag_mask)) != b.bitwiseAND(F.lit(~flag_mask))
    if field == "tlen" and tlen_by:
        return F.abs(a - b) > tlen_by
    return ~a.eqNullSafe(b)


def truncated(v: Column, n: int) -> Column:
    """At most n characters, then `...`; null is `!NULL!`."""
    return F.when(v.isNull(), "!NULL!").when(F.length(v) > n, F.concat(F.left(v, F.lit(n)), F.lit("..."))).otherwise(v)


def rows(a: DataFrame, b: DataFrame, ignore: set[str] = frozenset(), flag_mask: int = 0, tlen_by: int = 0, width: int = 1000) -> DataFrame:
    """rec_idx, field, left_value, right_value of each field that differs between the n-th records."""
    fields = [f for f in FIELDS + ("rnext", "pnext", "tlen") if f in a.columns and f in b.columns and f not in ignore]
    x = a.select("rec_idx", F.struct(*fields).alias("a"))
    y = b.select("rec_idx", F.struct(*fields).alias("b"))
    both = x.join(y, "rec_idx")
    items = [
        F.when(_differs(f, F.col("a")[f], F.col("b")[f], flag_mask, tlen_by), F.struct(F.lit(f).alias("field"), truncated(F.col("a")[f].cast("string"), width).alias("left_value"), truncated(F.col("b")[f].cast("string"), width).alias("right_value")))
        for f in fields
    ]
    return both.select("rec_idx", F.explode(F.array_compact(F.array(*items))).alias("d")).select("rec_idx", "d.*")


def tags(a: DataFrame, b: DataFrame, include: set[str] = frozenset(), ignore: set[str] = frozenset()) -> DataFrame:
    """rec_idx, tag, side, left_value, right_value. Each side's tags are held against the other's: a changed tag comes twice (sides 1 and 2), a missing one once."""
    both = a.select("rec_idx", F.col("tags").alias("x")).join(b.select("rec_idx", F.col("tags").alias("y")), "rec_idx")

    def side(n: int, mine: str, other: str) -> Column:
        def entry(e):
            o = F.try_element_at(F.col(other), e["key"])
            left, right = (e["value"], o) if n == 1 else (o, e["value"])
            return F.when(~e["value"].eqNullSafe(o), F.struct(e["key"].alias("tag"), F.lit(n).alias("side"), left["value"].alias("left_value"), right["value"].alias("right_value")))

        return F.transform(F.map_entries(mine), entry)

    d = both.select("rec_idx", F.explode(F.array_compact(F.concat(side(1, "x", "y"), side(2, "y", "x")))).alias("d")).select("rec_idx", "d.*")
    if ignore:
        d = d.where(~F.col("tag").isin(*sorted(ignore)))
    return d.where(F.col("tag").isin(*sorted(include))) if include else d


def first_differences(differences: DataFrame, most: int) -> DataFrame:
    """Differences of the records up to the one with which `most` differences are reached; all of that record's."""
    last = differences.select("rec_idx").orderBy("rec_idx").limit(most).agg(F.max("rec_idx").alias("last"))
    return differences.join(F.broadcast(last), F.col("rec_idx") <= F.col("last"), "left_semi")  # one row


def discrepancies(a: DataFrame, b: DataFrame, record=None, **how) -> DataFrame:
    """The table of differences: counter, field, tag, premature, value1, value2, name1, name2, record1, record2.

    Differing fields and tags of records that both files have (premature 0), and each record that only one has: premature 1
    where the first file lacks it, 2 where the second does. record: a function of a DataFrame giving the Column of a whole record's
    text (none: null).
    """
    text = record or (lambda df: F.lit(None).cast("string"))
    x = a.select("rec_idx", F.col("qname").alias("name1"), text(a).alias("record1"))
    y = b.select("rec_idx", F.col("qname").alias("name2"), text(b).alias("record2"))
    f = rows(a, b, **how).select("rec_idx", "field", F.lit(None).cast("string").alias("tag"), F.col("left_value").alias("value1"), F.col("right_value").alias("value2"))
    found = f
    if "tags" in a.columns and "tags" in b.columns:
        found = f.union(tags(a, b).select("rec_idx", F.lit("TAG"), "tag", "left_value", "right_value"))
    both = found.join(x, "rec_idx").join(y, "rec_idx").withColumn("premature", F.lit(0))
    lone = x.join(y, "rec_idx", "full").where("name1 is null or name2 is null")
    lone = lone.withColumn("premature", F.when(F.col("name1").isNull(), 1).otherwise(2))
    columns = ["rec_idx", "field", "tag", "premature", "value1", "value2", "name1", "name2", "record1", "record2"]
    none = {c: F.lit(None).cast("string") for c in ("field", "tag", "value1", "value2")}
    return both.select(*columns).unionByName(lone.withColumns(none).select(*columns)).withColumnRenamed("rec_idx", "counter")


def premature_end(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: premature_end 1 if the first file is shorter, 2 if the second is, 0 if neither; and by how many records."""
    n = a.select(F.lit(1).alias("side")).union(b.select(F.lit(2).alias("side"))).agg(F.count(F.when(F.col("side") == 1, 1)).alias("n1"), F.count(F.when(F.col("side") == 2, 1)).alias("n2"))
    return n.select(F.when(F.col("n1") < F.col("n2"), 1).when(F.col("n1") > F.col("n2"), 2).otherwise(0).alias("premature_end"), F.abs(F.col("n1") - F.col("n2")).alias("missing"))


def summary(fields: DataFrame, tag_rows: DataFrame) -> DataFrame:
    """what, n: differences of each field and tag."""
    return fields.select(F.col("field").alias("what")).union(tag_rows.select(F.concat(F.lit("tag:"), "tag"))).groupBy("what").agg(F.count("*").alias("n"))
