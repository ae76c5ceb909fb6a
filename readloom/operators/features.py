"""Reads as differences from the contig, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import cigar
from readloom.operators.pileup import TILE, cigar_elements, with_stretch

FEATURE = "array<struct<op:string,pos:int,len:int,bases:string>>"


def read_features(reads: DataFrame, ref: DataFrame, tile: int = TILE) -> DataFrame:
    """rec_idx, idx, op, pos (1-based in the read), len, bases: S, I, D, N, H and P elements, X for a substituted base; matching bases have none."""
    whole = with_stretch(reads.where("flag & 4 = 0"), ref, tile)
    e = cigar_elements(whole.select("rec_idx", "cigar", "seq", "stretch"))
    k = F.transform(F.sequence(F.lit(1), F.col("len")), lambda k: F.struct(k.alias("k"), F.substring(F.col("seq"), F.col("q0") + k, F.lit(1)).alias("b"), F.substring(F.col("stretch"), F.col("r0") + k, F.lit(1)).alias("t")))
    subs = F.transform(F.filter(k, lambda x: x["b"] != x["t"]), lambda x: F.struct(F.lit("X").alias("op"), (F.col("q0") + x["k"]).alias("pos"), F.lit(1).alias("len"), x["b"].alias("bases")))
    text = F.when(F.col("op").isin("S", "I"), F.expr("substring(seq, q0 + 1, len)"))
    other = F.array(F.struct(F.col("op"), (F.col("q0") + 1).alias("pos"), F.col("len"), text.alias("bases")))
    # an element that agrees is one comparison; letters are taken apart only where one differs
    agrees = F.substring(F.col("seq"), F.col("q0") + 1, F.col("len")) == F.substring(F.col("stretch"), F.col("r0") + 1, F.col("len"))
    found = F.when(F.col("op").isin("M", "=", "X"), F.when(agrees, F.array().cast(FEATURE)).otherwise(subs)).otherwise(other)
    return e.select("rec_idx", "idx", F.explode(found).alias("f")).select("rec_idx", "idx", "f.op", "f.pos", "f.len", "f.bases")


def feature_arrays(features: DataFrame) -> DataFrame:
    """rec_idx and its features in order of position; a read has as many as it has differences."""
    return features.groupBy("rec_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "idx", "op", "len", "bases"))).alias("features"))


def restore_bases(reads: DataFrame, features: DataFrame, ref: DataFrame, tile: int = TILE) -> DataFrame:
    """rec_idx and seq, made from pos, the read's length and its features alone (the CIGAR only tells how much of the contig is looked up)."""
    r = with_stretch(reads.where("flag & 4 = 0").select("rec_idx", "rname", "pos", "cigar", "seq"), ref, tile)
    r = r.select("rec_idx", F.length("seq").alias("size"), "stretch").join(feature_arrays(features), "rec_idx", "left")
    none = F.array().cast("array<struct<pos:int,idx:int,op:string,len:int,bases:string>>")
    start = F.struct(F.lit("").alias("seq"), F.lit(1).alias("at"))
    gap = lambda a, upto: F.substring(F.col("stretch"), a["at"], upto - 1 - F.length(a["seq"]))

    def step(a, f):
        lead = F.greatest(f["pos"] - 1 - F.length(a["seq"]), F.lit(0))
        text = F.concat(a["seq"], F.substring(F.col("stretch"), a["at"], lead), F.when(f["op"].isin("S", "I", "X"), f["bases"]).otherwise(""))
        on = F.when(f["op"].isin("D", "N"), f["len"]).when(f["op"] == "X", 1).otherwise(0)
        return F.struct(text.alias("seq"), (a["at"] + lead + on).alias("at"))

    done = F.aggregate(F.coalesce("features", none), start, step, lambda a: F.concat(a["seq"], gap(a, F.col("size") + 1)))
    return r.select("rec_idx", F.rpad(done, F.col("size"), F.lit("N")).alias("seq"))


def restore_scores(reads: DataFrame, scores: DataFrame, default: int = 30) -> DataFrame:
    """rec_idx and qual: the default everywhere, overwritten at stored positions. scores: rec_idx, read_pos, score; a score below 0 counts as missing."""
    kept = scores.where("score >= 0").groupBy("rec_idx").agg(F.map_from_entries(F.collect_list(F.struct("read_pos", "score"))).alias("kept"))
    r = reads.select("rec_idx", F.length("seq").alias("size")).join(kept, "rec_idx", "left")
    at = lambda i: F.char(F.coalesce(F.try_element_at(F.col("kept"), i), F.lit(default)) + 33)
    return r.select("rec_idx", F.array_join(F.transform(F.sequence(F.lit(1), F.col("size")), at), "").alias("qual"))


def cigar_of(features: Column, size: Column) -> Column:
    """CIGAR from features: gaps are M, equal neighbours one element, the rest of the read M."""
    start = F.struct(F.array().cast("array<struct<len:int,op:string>>").alias("ops"), F.lit(1).alias("at"))
    one = lambda n, op: F.array(F.struct(n.cast("int").alias("len"), op.alias("op")))

    def step(a, f):
        lead = f["pos"] - a["at"]
        op = F.when(f["op"] == "X", "M").otherwise(f["op"])
        ops = F.concat(a["ops"], F.when(lead > 0, one(lead, F.lit("M"))).otherwise(F.array().cast("array<struct<len:int,op:string>>")), one(f["len"], op))
        takes = F.when(op.isin("M", "S", "I"), f["len"]).otherwise(0)
        return F.struct(ops.alias("ops"), (f["pos"] + takes).cast("int").alias("at"))

    def finish(a):
        rest = size - a["at"] + 1
        return F.concat(a["ops"], F.when(rest > 0, one(rest, F.lit("M"))).otherwise(F.array().cast("array<struct<len:int,op:string>>")))

    return cigar.render(cigar.merged(F.aggregate(features, start, step, finish)))


def reversed_positions(features: Column, size: Column) -> Column:
    """Features of the read turned round: 0-based positions size - pos - 1, in reverse order."""
    return F.reverse(F.transform(features, lambda f: F.struct((size - f["pos"] - 1).alias("pos"), f["op"].alias("op"))))


def trim(reads: DataFrame, length: int) -> DataFrame:
    """Reads cut to `length` bases: CIGAR, bases and scores. Deletions and skips before the cut stay; those after it go."""
    start = F.struct(F.array().cast("array<struct<len:int,op:string>>").alias("ops"), F.lit(length).alias("left"))

    def step(a, e):
        takes = e["op"].isin(*cigar.READ_OPS)
        n = F.when(takes, F.least(e["len"], a["left"])).otherwise(e["len"])
        ops = F.when(a["left"] > 0, F.concat(a["ops"], F.array(F.struct(n.alias("len"), e["op"].alias("op"))))).otherwise(a["ops"])
        return F.struct(ops.alias("ops"), (a["left"] - F.when(takes, n).otherwise(0)).alias("left"))

    ops = F.aggregate(cigar.parse(F.col("cigar")), start, step, lambda a: a["ops"])
    return reads.withColumns({"cigar": cigar.render(ops), "seq": F.substring("seq", 1, length), "qual": F.substring("qual", 1, length)})
