"""Reference sequences: lookups, checksums, dictionaries, FASTA layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def region(ref: DataFrame, name: str, start: int = 1, stop: int | None = None) -> DataFrame:
    """rname and seq of a stretch, clipped at the contig's ends; empty beyond."""
    n = F.lit((1 << 31) - 1 if stop is None else max(0, stop - max(1, start) + 1))
    return ref.where(F.col("rname") == name).select("rname", F.substring("seq", F.lit(max(1, start)), n).alias("seq"))


def strict_region(ref: DataFrame, name: str, start: int, stop: int) -> DataFrame:
    """As region(), but a stretch outside the contig is an error."""
    inside = (F.lit(start) >= 1) & (F.lit(stop) <= F.length("seq")) & (F.lit(start) <= F.lit(stop))
    whole = ref.where(F.col("rname") == name).withColumn("seq", F.when(inside, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("outside of "), "rname")).cast("string")))
    return region(whole, name, start, stop)


def checksums(ref: DataFrame) -> DataFrame:
    return ref.select("ref_id", "rname", F.length("seq").alias("length"), F.md5(F.upper("seq")).alias("md5"))


def check_spans(spans: DataFrame, ref: DataFrame) -> DataFrame:
    """spans (id, rname, start, span, md5) with `found` and `ok`: the checksum of the contig's stretch."""
    found = F.md5(F.upper(F.expr("substring(seq, start, span)")))
    return spans.join(ref.select("rname", "seq"), "rname", "left").select("id", "rname", found.alias("found"), F.coalesce(F.col("md5") == found, F.lit(False)).alias("ok"))


def fix_dictionary(dictionary: DataFrame, ref: DataFrame, uri: str | None = None, replace: bool = True) -> DataFrame:
    """Dictionary rows (rname, length, md5) with length and checksum of the reference; a wrong checksum is replaced, or an error; contigs that the reference lacks stay as they are."""
    own = checksums(ref).select("rname", F.col("length").alias("true_length"), F.col("md5").alias("true_md5"))
    d = dictionary.join(own, "rname", "left")
    wrong = F.col("md5").isNotNull() & F.col("true_md5").isNotNull() & (F.col("md5") != F.col("true_md5"))
    md5 = F.coalesce("true_md5", "md5")
    if not replace:
        md5 = F.when(wrong, F.raise_error(F.concat(F.lit("checksum differs: "), "rname")).cast("string")).otherwise(md5)
    return d.select("rname", F.coalesce("true_length", "length").alias("length"), md5.alias("md5"), wrong.alias("was_wrong"), (F.format_string(uri, "true_md5") if uri else F.lit(None).cast("string")).alias("uri"))


def name_variants(names: DataFrame, known: DataFrame) -> DataFrame:
    """asked, rname: the known contig of each asked name: itself, else M for MT or back, without or with `chr`, chrM as MT; null if none."""
    n = F.col("asked")
    short = F.regexp_replace(n, "^chr", "")
    tries = F.array(n, F.when(n == "M", "MT").when(n == "MT", "M"), F.when(n.startswith("chr"), short).otherwise(F.concat(F.lit("chr"), n)), F.when(n == "chrM", "MT").when(n == "MT", "chrM"))
    t = names.select("asked", F.posexplode(tries).alias("i", "rname")).where("rname is not null")
    hit = t.join(known.select("rname").distinct(), "rname").groupBy("asked").agg(F.min_by("rname", "i").alias("rname"))
    return names.join(hit, "asked", "left")


def fasta_index(ref: DataFrame, width: int = 60) -> DataFrame:
    """rname, length, start (byte offset of the first base), line_bases, line_bytes of a FASTA with contigs by ref_id, `>name` headers and lines of `width`."""
    lines = F.ceil(F.length("seq") / width)
    size = 2 + F.length("rname") + F.length("seq") + lines
    before = F.coalesce(F.sum(size).over(Window.orderBy("ref_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each contig
    return ref.select("rname", F.length("seq").alias("length"), (before + 2 + F.length("rname")).cast("long").alias("start"), F.lit(width).alias("line_bases"), F.lit(width + 1).alias("line_bytes"))


def wrapped(ref: DataFrame, width: int = 80) -> DataFrame:
    """rname and its FASTA text, `>name md5` and lines of `width`."""
    body = F.regexp_replace("seq", "(.{%d})(?=.)" % width, "$1\n")
    return ref.select("rname", F.concat(F.lit(">"), "rname", F.lit(" "), F.md5(F.upper("seq")), F.lit("\n"), body, F.lit("\n")).alias("text"))


def repo_lines(ref: DataFrame, folder: str) -> DataFrame:
    """One `@SQ` line for each contig of a repository of reference files."""
    return ref.select("ref_id", F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "rname"), F.concat(F.lit("LN:"), F.length("seq")), F.concat(F.lit("UR:file://" + folder + "/"), "rname", F.lit(".fa")), F.concat(F.lit("M5:"), F.md5(F.upper("seq")))).alias("line"))


def parse_repo(lines: DataFrame, column: str = "line") -> DataFrame:
    get = lambda k, p: F.regexp_extract(column, rf"\t{k}:({p})", 1)
    return lines.select(get("SN", r"[^\t]+").alias("rname"), get("LN", r"\d+").cast("int").alias("length"), get("UR", r"[^\t]+").alias("uri"), get("M5", r"[0-9a-fA-F]{32}").alias("md5"))


def repo_map(entries: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of each key."""
    return entries.groupBy(key).agg(F.max_by(F.struct(*(c for c in entries.columns if c != key)), order).alias("e")).select(key, "e.*")


def add_missing(cache: DataFrame, new: DataFrame, key: str = "md5") -> DataFrame:
    """The cache and those new rows whose key it lacks."""
    return cache.unionByName(new.join(cache.select(key), key, "left_anti").dropDuplicates([key]))
