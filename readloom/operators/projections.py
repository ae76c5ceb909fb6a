"""Selection of fields and tags, names, enumeration and limits."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import tags as tag
from readloom.operators.cuts import numbered
from readloom.schema import FIELDS


@dataclass
class Selector:
    """Fields and tags to take: `SEQ:RNAME/NM:AM`, `*` for all, names after `*` are left out.

    Without `/` two-letter names that are no field are tags, and a `*` before fields also means all tags.
    """

    fields: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    all_fields: bool = False
    all_tags: bool = False

    @classmethod
    def parse(cls, spec: str) -> Selector:
        left, slash, right = spec.partition("/")
        if not re.fullmatch(r"[*]?[A-Z:]*", left) and not re.fullmatch(r"[*]?[A-Z0-9:]*", left) or not re.fullmatch(r"[*]?[A-Z0-9:]*", right):
            raise ValueError(f"not a selector: {spec!r}")
        star = left.startswith("*")
        names = [x for x in left.lstrip("*").split(":") if x]
        if unknown := [x for x in names if x not in FIELDS and len(x) != 2]:
            raise ValueError(f"no such field: {unknown}")
        fields = [x for x in names if x in FIELDS]
        tags = [x for x in names if x not in FIELDS] + [x for x in right.lstrip("*").split(":") if x]
        return cls(fields, tags, star, right.startswith("*") if slash else star)

    def __str__(self) -> str:
        left = "*" * self.all_fields + ":".join(self.fields)
        right = "*" * self.all_tags + ":".join(self.tags)
        return left + ("/" + right if right or self.all_fields != self.all_tags else "")

    def takes_field(self, name: str) -> bool:
        return (name in self.fields) != self.all_fields

    def takes_tag(self, name: str) -> bool:
        return (name in self.tags) != self.all_tags

    def columns(self) -> list[Column]:
        """Columns of the fields, then the tags as one map."""
        out = [F.col(c).cast("string").alias(c) for n, c in FIELDS.items() if self.takes_field(n)]
        if self.all_tags or self.tags:
            keep = (lambda k, v: ~k.isin(*self.tags)) if self.all_tags and self.tags else (lambda k, v: F.lit(True)) if self.all_tags else (lambda k, v: k.isin(*self.tags))
            out.append(F.map_filter("tags", keep).alias("tags"))
        return out


def select(reads: DataFrame, spec: str) -> DataFrame:
    """The chosen fields as text and the chosen tags; absent columns are left out."""
    s = Selector.parse(spec)
    fields = [F.col(c).cast("string").alias(c) for n, c in FIELDS.items() if s.takes_field(n) and c in reads.columns]
    return reads.select("rec_idx", *fields, *([s.columns()[-1]] if s.all_tags or s.tags else []))


def tabular(reads: DataFrame, spec: str, prefix: Column | None = None) -> DataFrame:
    """One line for each record: the chosen fields, then `TAG:typevalue` of the chosen tags by name, separated by tabs."""
    s = Selector.parse(spec)
    cols = [F.col(c).cast("string") for n, c in FIELDS.items() if s.takes_field(n) and c in reads.columns]
    line = F.concat_ws("\t", *([prefix.cast("string")] if prefix is not None else []), *cols, F.transform(F.array_sort(F.map_entries(s.columns()[-1])), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["type"], e["value"]["value"])) if s.all_tags or s.tags else F.lit(None).cast("string"))
    return reads.select("rec_idx", line.alias("line"))


def text_of(value: Column, kind: str) -> Column:
    """A value as text: arrays as `[a, b]`, null stays null."""
    return F.concat(F.lit("["), F.array_join(value, ", "), F.lit("]")) if kind.startswith("array") else value.cast("string")


def capped(value: Column, n: int) -> Column:
    """At most n characters."""
    return F.substring(value, 1, n)


def skip_take(reads: DataFrame, skip: int = 0, take: int | None = None) -> DataFrame:
    """Records skip+1 .. skip+take in input order, with their 1-based number in `ordinal`.

    With a limit only that many rows are ordered; without one numbers are dealt by ranges.
    """
    if take is None:
        return numbered(reads, ["rec_idx"], "ordinal").where(F.col("ordinal") > skip)
    kept = reads.orderBy("rec_idx").offset(skip).limit(take)
    return kept.withColumn("ordinal", F.row_number().over(Window.orderBy("rec_idx")) + skip)


def prefixed_names(reads: DataFrame, source: Column) -> DataFrame:
    return reads.withColumn("qname", F.concat(source.cast("string"), F.lit("."), F.col("qname")))


def template_numbers(reads: DataFrame, slices: int = 64) -> DataFrame:
    """`template`: 1.. over read names by first appearance, the same for a pair.

    Names are few beside records; numbers are dealt in two steps (within ranges of first appearance, then the
    ranges' totals), so no single task orders all names.
    """
    names = reads.groupBy("qname").agg(F.min("rec_idx").alias("first"))
    return reads.join(numbered(names, ["first"], "template", slices).select("qname", "template"), "qname")


def fastq_names(reads: DataFrame, prefix: str) -> DataFrame:
    """`new_name`: prefix.number name; the number is the template's."""
    return template_numbers(reads).withColumn("new_name", F.concat(F.lit(prefix + "."), F.col("template").cast("string"), F.lit(" "), F.col("qname")))


def generated_names(reads: DataFrame, group: Column) -> DataFrame:
    """Missing names become the ordinal of the first record of their mate group."""
    first = F.min("rec_idx").over(Window.partitionBy(group))
    return reads.withColumn("qname", F.coalesce("qname", first.cast("string")))


def with_read_group(reads: DataFrame, name: str) -> DataFrame:
    return reads.withColumn("tags", tag.put(F.col("tags"), "RG", "Z", F.lit(name)))
