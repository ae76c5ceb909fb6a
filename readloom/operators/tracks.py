"""Counts along contigs as tracks: runs of positions, held by windows, which reads meet as a whole.

A track has a row for each window of TILE positions, with the runs of this window and of the next one in small cells of CELL
positions, so that a read no longer than a window finds all its positions in the window in which it begins. A read takes the cells under it
and spreads their runs to one count for each position: the join moves reads and windows, never positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators import pileup

TILE, CELL = 1 << 16, 256


def capped(runs: DataFrame, most: int, tile: int = 1_000_000) -> DataFrame:
    """runs with counts of `most` at most, neighbours of one count put together: where only counts below `most` are told apart, most of a well covered contig is one run a window of `tile` positions."""
    w = Window.partitionBy("rname", "__tile").orderBy("begin")
    r = runs.select("rname", "begin", "stop", F.least("n", F.lit(most)).alias("n"), F.floor((F.col("begin") - 1) / tile).alias("__tile"))
    same = (F.lag("stop").over(w) == F.col("begin")) & (F.lag("n").over(w) == F.col("n"))
    r = r.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    return r.groupBy("rname", "__tile", "__run").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.first("n").alias("n")).select("rname", "begin", "stop", "n")


def build(runs: DataFrame, tile: int = TILE, cell: int = CELL) -> DataFrame:
    """rname, tile, cells (map of a cell's number to its runs, in order). runs: rname, begin, stop (exclusive), n, without overlap."""
    r = runs.withColumn("cell", F.explode(F.sequence(F.floor((F.col("begin") - 1) / cell), F.floor((F.col("stop") - 2) / cell))))
    low, high = F.greatest(F.col("begin"), F.col("cell") * cell + 1), F.least(F.col("stop"), (F.col("cell") + 1) * cell + 1)
    run = F.struct(low.cast("long").alias("begin"), high.cast("long").alias("stop"), F.col("n").cast("int").alias("n"))
    cells = r.groupBy("rname", "cell").agg(F.array_sort(F.collect_list(run)).alias("runs"))  # at most `cell` runs
    own = F.floor(F.col("cell") * cell / tile)
    both = cells.withColumn("tile", F.explode(F.array(own, own - 1)))
    return both.where("tile >= 0").groupBy("rname", "tile").agg(F.map_from_entries(F.collect_list(F.struct("cell", "runs"))).alias("cells"))


def _near(first: Column, last: Column, cell: int) -> tuple[Column, Column]:
    """The runs of the first cell and of the two after it, where a read has no more, and otherwise all cells. These are taken where a read meets its window, so that no row carries more of the window than that."""
    one, end = F.floor((first - 1) / cell), F.floor((last - 1) / cell)
    none = F.array().cast("array<struct<begin:bigint,stop:bigint,n:int>>")
    few = (end - one <= 2) & F.col("cells").isNotNull() & (last >= first)
    return F.when(few, F.array(*(F.coalesce(F.when(one + i <= end, F.try_element_at("cells", one + i)), none) for i in range(3)))), F.when(~few, F.col("cells"))


def _counts(first: Column, last: Column, cell: int) -> Column:
    """The counts of positions first to last, of `__near` or `__more`: the runs under them, with noughts between."""
    under = F.sequence(F.floor((first - 1) / cell), F.floor((last - 1) / cell))
    none = F.array().cast("array<struct<begin:bigint,stop:bigint,n:int>>")
    runs = F.when(F.col("__near").isNotNull(), F.flatten("__near")).when(F.col("__more").isNotNull() & (last >= first), F.flatten(F.transform(under, lambda k: F.coalesce(F.try_element_at("__more", k), none))))
    runs = F.filter(runs, lambda x: (x["stop"] > first) & (x["begin"] <= last))

    def spread(x, i):
        before = F.when(i == 0, first).otherwise(F.try_element_at(F.col("__runs"), i)["stop"])
        begin = F.greatest(x["begin"], first)
        return F.concat(F.array_repeat(F.lit(0), (begin - before).cast("int")), F.array_repeat(x["n"], (F.least(x["stop"], last + 1) - begin).cast("int")))

    return runs, lambda: F.flatten(F.transform(F.col("__runs"), spread))


def with_counts(reads: DataFrame, track: DataFrame, ref: DataFrame, last: Column, name: str, tile: int = TILE, cell: int = CELL) -> DataFrame:
    """reads with an array `name`: the counts of the positions from pos to `last`, without the noughts after the last run; null where none has one. ref tells how long contigs are.

    Reads longer than a window are taken apart into windows and put together by rec_idx, in a plan that is made only where there may be such.
    """
    first = F.greatest(F.col("pos"), F.lit(1)).cast("long")
    r = reads.withColumns({"__first": first, "__last": last.cast("long")})
    r = r.withColumn("tile", F.floor((F.col("__first") - 1) / tile))
    extent = F.col("__last") - F.col("__first") + 1
    longer = pileup.has_longer(r, ref, extent, tile)

    def met(df: DataFrame, begin: Column, stop: Column) -> DataFrame:
        runs, spread = _counts(begin, stop, cell)
        near, more = _near(begin, stop, cell)
        df = df.join(track, ["rname", "tile"], "left").withColumns({"__near": near, "__more": more}).drop("cells")
        return df.withColumn("__runs", runs).withColumn(name, spread())

    short = met(r.where(extent <= tile) if longer else r, F.col("__first"), F.col("__last")).select(*reads.columns, name)
    if not longer:
        return short
    long = r.where(extent > tile)
    asked = long.select("rec_idx", "rname", "__first", "__last", F.explode(F.sequence("tile", F.floor((F.col("__last") - 1) / tile))).alias("tile"))
    asked = asked.withColumns({"__b": F.greatest("__first", F.col("tile") * tile + 1), "__e": F.least("__last", (F.col("tile") + 1) * tile)})
    got = met(asked, F.col("__b"), F.col("__e")).withColumn("__n", (F.col("__e") - F.col("__b") + 1).cast("int"))
    got = got.withColumn(name, F.coalesce(name, F.array().cast("array<int>")))
    got = got.withColumn(name, F.concat(name, F.array_repeat(F.lit(0), F.col("__n") - F.size(name))))
    whole = got.groupBy("rec_idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tile", name))), lambda x: x[name])).alias(name))
    return short.unionByName(long.select(*reads.columns).join(whole, "rec_idx", "left"))
