"""Typed tags: a map from a two-letter name to (type, value as text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer types from the narrowest on, with their least and greatest value and size in bytes.
INTEGERS = (("c", -128, 127, 1), ("C", 0, 255, 1), ("s", -32768, 32767, 2), ("S", 0, 65535, 2), ("i", -(1 << 31), (1 << 31) - 1, 4), ("I", 0, (1 << 32) - 1, 4))
ELEMENT = {"c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def integer_type(v: Column) -> Column:
    """The narrowest type that holds v; an error if none does."""
    out = F.raise_error(F.concat(F.lit("integer tag out of range: "), v.cast("string"))).cast("string")
    for name, low, high, _ in reversed(INTEGERS):
        out = F.when(v.between(low, high), name).otherwise(out)
    return out


def byte_size(kind: Column, value: Column) -> Column:
    """Bytes of a value: text without its end mark, arrays with their type and count."""
    items = F.size(F.split(value, ",")) - 1
    one = F.lit(4)
    for k, n in ELEMENT.items():
        one = F.when(F.substring(value, 1, 1) == k, n).otherwise(one)
    out = F.when(kind == "Z", F.length(value)).when(kind == "A", 1).when(kind == "B", 5 + items * one)
    for k, n in ELEMENT.items():
        out = out.when(kind == k, n)
    return out


def get(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))["value"]


def put(tags: Column, name: str, kind: str, value: Column) -> Column:
    entry = F.create_map(F.lit(name), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value")))
    return F.map_concat(F.map_filter(tags, lambda k, v: k != name), entry)


def kept(tags: Column, capture: set[str] | None = None, ignore: set[str] = frozenset()) -> Column:
    """Tags of `capture` (None: all), less those of `ignore`."""
    return F.map_filter(tags, lambda k, v: (F.lit(True) if capture is None else k.isin(*sorted(capture))) & (~k.isin(*sorted(ignore)) if ignore else F.lit(True)))


def names(spec: str) -> set[str]:
    """`OQ:XA:XB` as a set of two-letter names."""
    out = set(filter(None, spec.split(":")))
    if bad := [x for x in out if len(x) != 2]:
        raise ValueError(f"tag names have two letters: {sorted(bad)}")
    return out


def text(tags: Column) -> Column:
    """`NAME:type:value` of all tags by name, separated by blanks; a stable form for comparing and printing."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"])), " ")
