"""Mates: joining the reads of a template, insert sizes, mate fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import pair
from readloom.functions.flags import has

_END = ("flag", "rname", "pos", "aln_end")


def by_name(reads: DataFrame) -> DataFrame:
    """Each name's first two records (by input order) as a pair; a name seen once has no partner.

    Columns: qname, rec_a, rec_b, n. Any two records of one name pair, as the mate bits may be wrong.
    """
    w = Window.partitionBy("qname").orderBy("rec_idx")
    r = reads.select("qname", "rec_idx", F.row_number().over(w).alias("i"))
    return r.groupBy("qname").agg(F.min(F.when(F.col("i") == 1, F.col("rec_idx"))).alias("rec_a"), F.min(F.when(F.col("i") == 2, F.col("rec_idx"))).alias("rec_b"), F.count("*").alias("n"))


def mate_pairs(reads: DataFrame) -> DataFrame:
    return by_name(reads).where("rec_b is not null").select("qname", "rec_a", "rec_b")


def orphans(reads: DataFrame) -> DataFrame:
    """Records without a partner of their name."""
    return reads.join(by_name(reads).where("rec_b is null").select(F.col("rec_a").alias("rec_idx")), "rec_idx", "left_semi")


def collated(reads: DataFrame) -> DataFrame:
    """rec_idx and stream: 0 for orphans, else 1 for the first of the pair (by its bit; the earlier one if the bits don't tell) and 2 for its mate."""
    w = Window.partitionBy("qname").orderBy("rec_idx")
    r = reads.select("qname", "rec_idx", "flag", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("qname")).alias("n"))
    r = r.withColumn("swap", F.max(F.when((F.col("i") == 2) & has(F.col("flag"), 64), 1).otherwise(0)).over(Window.partitionBy("qname")))
    return r.select("rec_idx", F.when((F.col("n") < 2) | (F.col("i") > 2), 0).otherwise(F.when(F.col("swap") == 1, 3 - F.col("i")).otherwise(F.col("i"))).alias("stream"))


def link_by_offset(reads: DataFrame, distance: Column) -> DataFrame:
    """rec_idx and mate_idx: the record `distance` + 1 after it; null distances have no mate."""
    r = reads.select("rec_idx", (F.col("rec_idx") + distance + 1).alias("mate_idx")).where("mate_idx is not null")
    return r.join(reads.select(F.col("rec_idx").alias("mate_idx")), "mate_idx", "left_semi").select("rec_idx", "mate_idx")


def segments(reads: DataFrame) -> DataFrame:
    """One row for each name: qname and the record that stands for its first (`seg_64`), second (`seg_128`) and any other segment (`seg_0`), as structs; null where there is none.

    A segment's primary record stands for it (neither secondary nor supplementary), of several the earliest; a segment without
    one is stood for by its earliest record. Found by aggregates that are combined before the shuffle, however many records a name has.
    """
    keep = [c for c in ("rec_idx", "qname", "flag", "rname", "pos", "mapq", "aln_end") if c in reads.columns]
    bits = F.col("flag").bitwiseAND(192)
    order = F.struct(has(F.col("flag"), 2304).alias("further"), "rec_idx")

    def least(bit: int) -> Column:
        mine = bits == bit if bit else ~bits.isin(64, 128)
        return F.min_by(F.when(mine, F.struct(*keep)), F.when(mine, order)).alias(f"seg_{bit}")

    return reads.groupBy("qname").agg(*map(least, (64, 128, 0)))


def mates(reads: DataFrame) -> DataFrame:
    """a and b: structs of a record and of the record that stands for its mate (see segments()); one row for each record whose name has another segment.

    Secondary and supplementary records have the other segment's primary record as their mate, and are nobody's mate where a
    primary one exists. Records meet one row for each name, so a name of many records makes no product.
    """
    keep = [c for c in ("rec_idx", "qname", "flag", "rname", "pos", "mapq", "aln_end") if c in reads.columns]
    bits = F.col("flag").bitwiseAND(192)
    other = F.when(bits == 64, F.coalesce("seg_128", "seg_0")).when(bits == 128, F.coalesce("seg_64", "seg_0")).otherwise(F.coalesce("seg_64", "seg_128"))
    return reads.select("qname", "flag", F.struct(*keep).alias("a")).join(segments(reads), "qname").select("a", other.alias("b")).where("b is not null")


def mate_info(reads: DataFrame) -> DataFrame:
    """rnext, pnext and tlen of each record from its mate; `*`, 0 and 0 without one. `=` isn't used."""
    m = mates(reads).select(F.col("a.rec_idx").alias("rec_idx"), F.col("b.rname").alias("rnext"), F.col("b.pos").alias("pnext"), pair.five_prime_size(F.col("a"), F.col("b")).alias("tlen"))
    return reads.join(m, "rec_idx", "left").withColumns({"rnext": F.coalesce("rnext", F.lit("*")), "pnext": F.coalesce("pnext", F.lit(0)), "tlen": F.coalesce("tlen", F.lit(0))})


def loose_mate_info(reads: DataFrame) -> DataFrame:
    """Mate fields by what is mapped: an unmapped record takes its mapped mate's place, and the size is signed by the leftmost. Columns: rec_idx, rname, pos, rnext, pnext, mate_mapq, mate_reverse, tlen."""
    m = mates(reads)
    ua, ub = has(F.col("a.flag"), 4), has(F.col("b.flag"), 4)
    here = F.when(ua & ~ub, F.struct(F.col("b.rname").alias("rname"), F.col("b.pos").alias("pos"))).otherwise(F.struct("a.rname", "a.pos"))
    there = F.when(ub & ~ua, F.struct(F.col("a.rname").alias("rname"), F.col("a.pos").alias("pos"))).otherwise(F.struct("b.rname", "b.pos"))
    return m.select(
        F.col("a.rec_idx").alias("rec_idx"), here["rname"].alias("rname"), here["pos"].alias("pos"), there["rname"].alias("rnext"), there["pos"].alias("pnext"),
        F.when(~ub, F.col("b.mapq")).alias("mate_mapq"), has(F.col("b.flag"), 16).alias("mate_reverse"), pair.outer_size(F.col("a"), F.col("b")).alias("tlen"),
    )


def template_extent(reads: DataFrame) -> DataFrame:
    """qname, first_pos, last_pos, extent of all placed segments; 0 where contigs differ or nothing is placed."""
    placed = ~has(F.col("flag"), 4)
    g = reads.groupBy("qname").agg(
        F.min(F.when(placed, F.col("pos"))).alias("first_pos"), F.max(F.when(placed, F.col("aln_end"))).alias("last_pos"),
        F.min("rname").alias("low"), F.max("rname").alias("high"),
    )
    return g.select("qname", "first_pos", "last_pos", F.when((F.col("low") == F.col("high")) & F.col("first_pos").isNotNull(), F.col("last_pos") - F.col("first_pos") + 1).otherwise(0).alias("extent"))


def next_segment(reads: DataFrame) -> DataFrame:
    """rec_idx and next_idx: the following record of the template, the last one's being the first."""
    w = Window.partitionBy("qname").orderBy("rec_idx")
    return reads.select("rec_idx", F.coalesce(F.lead("rec_idx").over(w), F.first("rec_idx").over(w)).alias("next_idx"))


def linked_by_name(reads: DataFrame) -> DataFrame:
    """rec_idx, mate_idx, detached: records of one name (and alike secondary or not) link first with second, and stay linked if sizes and places agree; a third one on is detached. Found over all records, not in batches."""
    w = Window.partitionBy("qname", has(F.col("flag"), 256)).orderBy("rec_idx")
    s = F.struct("rec_idx", *_END, "rnext", "pnext", "tlen")
    r = reads.select("rec_idx", F.row_number().over(w).alias("i"), s.alias("a"), F.when(F.row_number().over(w) == 1, F.lead(s).over(w)).when(F.row_number().over(w) == 2, F.lag(s).over(w)).alias("b"))
    a, b = F.col("a"), F.col("b")
    ok = (a["rnext"] == b["rname"]) & (a["pnext"] == b["pos"]) & (a["tlen"] == pair.five_prime_size(a, b)) & (b["rnext"] == a["rname"]) & (b["pnext"] == a["pos"]) & (b["tlen"] == pair.five_prime_size(b, a))
    good = b.isNotNull() & ok
    return r.select("rec_idx", F.when(good, b["rec_idx"]).alias("mate_idx"), (~F.coalesce(good, F.lit(False))).alias("detached"))


def flag_check(reads: DataFrame) -> DataFrame:
    m = mates(reads)
    return m.select(F.col("a.rec_idx").alias("rec_idx"), pair.flags_agree(F.col("a"), F.col("b")).alias("consistent"))
