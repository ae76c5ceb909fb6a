"""Counts and histograms over records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.qual import ILLUMINA_VALUES


def counts(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count("*").alias("reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))


def quality_histogram(reads: DataFrame, default: int = 30) -> DataFrame:
    """score, n, mark, letter; most frequent first. mark: `*` for the default score, `8` for a value of a binned file, else `40`. Reads without scores add nothing.

    Letters are taken apart and counted before the shuffle, so at most 94 rows leave each task.
    """
    letters = reads.where("qual is not null and qual <> '*'").select(F.explode(F.split("qual", "")).alias("c")).where("c <> ''")
    tall = letters.groupBy("c").agg(F.count("*").alias("n")).select((F.ascii("c") - 33).alias("score"), "n")
    mark = F.when(F.col("score") == default, "*").when(F.col("score").isin(*ILLUMINA_VALUES), "8").otherwise("40")
    return tall.select("score", "n", mark.alias("mark"), F.char(F.col("score") + 33).alias("letter")).orderBy(F.desc("n"), "score")


def flagstat_by_contig(reads: DataFrame, exclude: int = 2304, start: int = 100, end: int = 1500) -> DataFrame:
    """Reads, bases, summed mapping quality and last position of each contig, of records that overlap a stretch of it."""
    kept = reads.where((F.col("flag").bitwiseAND(exclude) == 0) & (F.col("pos") <= end) & (F.col("aln_end") >= start))
    return kept.groupBy("rname").agg(F.count("*").alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"), F.sum("mapq").alias("sum_mapq"), F.max("aln_end").alias("max_end"))


def bits_per_base(columns: DataFrame) -> DataFrame:
    """field, bytes, bits: eight times a field's bytes for each base. columns: field, value, with the bases as field `seq`; one row for each field is left when the bases are looked up."""
    size = columns.groupBy("field").agg(F.sum(F.octet_length("value")).alias("bytes"))
    bases = F.max(F.when(F.col("field") == "seq", F.col("bytes"))).over(Window.partitionBy())
    return size.select("field", "bytes", (F.col("bytes") * 8 / bases).alias("bits"))


def decompose(reads: DataFrame) -> DataFrame:
    """rec_idx, field, value: one row for each field and tag of each record."""
    plain = [c for c in ("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual") if c in reads.columns]
    items = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in plain))
    tagged = F.transform(F.map_entries("tags"), lambda e: F.struct(F.concat(F.lit("tag_"), e["key"]).alias("field"), e["value"]["value"].alias("value")))
    return reads.select("rec_idx", F.explode(F.concat(items, tagged)).alias("x")).select("rec_idx", "x.field", "x.value")


def mismatch_ratio_warning(reads_bases: DataFrame) -> DataFrame:
    """Whether there are fewer than three bases to a difference. reads_bases: bases, differences."""
    return reads_bases.agg(F.sum("bases").alias("bases"), F.sum("differences").alias("differences")).withColumn("abnormal", F.col("bases") < 3 * F.col("differences"))
