"""Queries on indexes, references, dictionaries, masks, evidence and streams."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import evidence, index, masks, refs
from readloom.plans.fixtures import reads, ref, table
from readloom.plans.registry import query


@query("""select cast(row_number() over (order by first_rec) - 1 as int) as stripe, rname, first_rec, n from (
    select rname, min(rec_idx) as first_rec, count(*) as n from (
      select rec_idx, rname, run, (row_number() over (partition by run order by rec_idx) - 1) // 100 as part from (
        select rec_idx, rname, sum(case when rname = prev then 0 else 1 end) over (order by rec_idx) as run from (
          select rec_idx, case when rec_idx < 400 then 'chr1' else rname end as rname, lag(case when rec_idx < 400 then 'chr1' else rname end) over (order by rec_idx) as prev from reads) a) b) c group by run, part, rname) d""", "reads")
def stripes(spark, d):
    r = reads(spark, d).withColumn("rname", F.expr("case when rec_idx < 400 then 'chr1' else rname end"))
    return index.stripes(r, 100)


@query("""with recursive s as (select (row_number() over (order by case when rname = '*' then 1 else 0 end, rname, pos, rec_idx) - 1) as i, rname from reads),
    t as (select sum(n) as total, list(first) filter (where first > 0) as starts, min(case when rname = '*' then first end) as bare from (select rname, min(i) as first, count(*) as n from s group by rname) f),
    c as (select cast(0 as bigint) as container, cast(0 as bigint) as first_rec, cast(least(1000, total, case when bare > 0 then bare else total end, coalesce(list_min(list_filter(starts, lambda x: x >= 100)), total)) as bigint) as stop from t
      union all select container + 1, stop, cast(least(stop + 1000, total, case when bare > stop then bare else total end, coalesce(list_min(list_filter(starts, lambda x: x - c.stop >= 100)), total)) as bigint) from c, t where stop < total)
    select container, first_rec, stop - first_rec as n from c""", "reads")
def containers(spark, d):
    from readloom.operators.cuts import numbered

    r = numbered(reads(spark, d).select("rec_idx", "rname", "pos"), [F.when(F.col("rname") == "*", 1).otherwise(0), "rname", "pos", "rec_idx"])
    return index.containers(r.select((F.col("place").cast("long") - 1).alias("rec_idx"), "rname"), size=1000, least=100)


_CRAI = """select case when rname = '*' then -1 else cast(regexp_extract(rname, '([0-9]+)$', 1) as int) - 1 end as seq_id, min(pos) as start, cast(case when rname = '*' then 0 else max(aln_end) - min(pos) + 1 end as int) as span,
   rec_idx // 1000 // 2 * 2000 as container_offset, rec_idx // 1000 % 2 * 1000 as slice_offset, count(*) as size from reads group by rname, rec_idx // 1000"""


@query(f"select * from ({_CRAI}) x", "reads")
def crai_build(spark, d):
    return index.slice_index(reads(spark, d)).orderBy(*index.index_order())


@query(f"select * from ({_CRAI}) x where seq_id = 1 and 300 < start + span and start < 500", "reads")
def crai_find(spark, d):
    return index.find(index.slice_index(reads(spark, d)), 1, 300, 200)


@query(f"select * from ({_CRAI}) x where seq_id = 2", "reads")
def crai_find_whole(spark, d):
    return index.find(index.slice_index(reads(spark, d)), 2, 0, 0)


@query(f"select seq_id, start, container_offset, slice_offset, span, size from ({_CRAI}) x qualify row_number() over (partition by seq_id order by start, container_offset, slice_offset) = 1", "reads")
def crai_leftmost(spark, d):
    return index.leftmost(index.slice_index(reads(spark, d)))


@query(f"select min(container_offset) as offset from ({_CRAI}) x where seq_id = 3 and 100 < start + span and start < 150", "reads")
def seek_offset(spark, d):
    return index.seek_offset(index.slice_index(reads(spark, d)), 3, 100, 50)


@query(f"select seq_id, start, span, container_offset, slice_offset, cast(row_number() over (order by seq_id desc, start, container_offset, slice_offset) as int) as place from ({_CRAI}) x", "reads")
def crai_find_order(spark, d):
    from pyspark.sql import Window

    i = index.slice_index(reads(spark, d))
    return i.select("seq_id", "start", "span", "container_offset", "slice_offset", F.row_number().over(Window.orderBy(*index.index_order("find"))).alias("place"))


_TARGETS = "select p_partkey as id, concat('chr', cast(p_partkey % 5 + 1 as varchar)) as rname, cast(1 + p_partkey * 37 % 1400 as int) as start, cast(1 + p_partkey * 37 % 1400 + p_size as int) as stop from part"


@query(f"select q.id as query_id, r.rec_idx as interval_id from ({_TARGETS}) q join reads r on r.rname = q.rname and r.pos <= q.stop and q.start <= r.aln_end where (r.flag & 4) = 0", "reads")
def interval_join(spark, d):
    q = table(spark, d, "part").selectExpr("p_partkey as id", "concat('chr', p_partkey % 5 + 1) as rname", "cast(1 + p_partkey * 37 % 1400 as int) as start", "cast(1 + p_partkey * 37 % 1400 + p_size as int) as stop")
    r = reads(spark, d).where("flag & 4 = 0").select(F.col("rec_idx").alias("id"), "rname", F.col("pos").alias("start"), F.col("aln_end").alias("stop"))
    return index.interval_join(q, r)


_BIN = "case when b >> 14 = e >> 14 then 4681 + (b >> 14) when b >> 17 = e >> 17 then 585 + (b >> 17) when b >> 20 = e >> 20 then 73 + (b >> 20) when b >> 23 = e >> 23 then 9 + (b >> 23) when b >> 26 = e >> 26 then 1 + (b >> 26) else 0 end"


@query(f"""select rname, cast({_BIN} as bigint) as bin, count(*) as n, min(rec_idx) as first_rec, max(rec_idx) as last_rec from (
    select rname, rec_idx, (pos - 1) * 997 as b, pos * 997 - 997 + (aln_end - pos) * (case when rec_idx % 50 = 0 then 997000 else 97 end) as e from reads where pos > 0) x group by 1, 2""", "reads")
def bin_table(spark, d):
    """Bins of reads on contigs stretched by 997, some of them long, so that all levels of bins occur."""
    far = F.expr("cast((pos - 1) * 997 + 1 + (aln_end - pos) * (case when rec_idx % 50 = 0 then 997000 else 97 end) as int)")
    return index.bin_table(reads(spark, d).where("pos > 0").withColumns({"aln_end": far, "pos": F.expr("cast((pos - 1) * 997 + 1 as int)")}))


@query(f"""with r as (select rname, (pos - 1) * 997 as b, (pos - 1) * 997 + (aln_end - pos) as e from reads where pos > 0)
    select rname, 'bin' as kind, cast({_BIN} as bigint) as key, cast(null as bigint) as n from r group by 1, 2, 3
    union all select rname, 'windows', cast(max(e // 16384) + 1 as bigint), null from r group by 1
    union all select rname, 'mapped', 0, count(*) from r group by 1
    union all select '*', 'loose', 0, count(*) from reads where pos = 0""", "reads")
def bai_round_trip(spark, d):
    """Sorted records, stretched by 997, as BAM files; their BAI files written and read again."""
    from readloom.sources import bai, bam

    r = reads(spark, d).withColumns({"pos": F.expr("cast(if(pos > 0, (pos - 1) * 997 + 1, 0) as int)"), "rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0)})
    # four files or more, as a file is one task's; there is a read for each order
    parts = max(4, -(-table(spark, d, "orders").count() // bam.RECORDS))
    order = [F.when(F.col("rname") == "*", 1).otherwise(0), "rname", "pos", "rec_idx"]
    files = bam.to_bam(r, [(f"chr{i}", 3_000_000) for i in range(1, 6)], parts=parts, order=order).select(F.col("part").cast("string").alias("path"), "content")
    i = bai.parsed(bai.to_bai(bai.index_rows_of(files)))
    name = F.when(F.col("ref") < 0, "*").otherwise(F.concat(F.lit("chr"), F.col("ref") + 1)).alias("rname")
    by = lambda kind, what, key, n: i.where(F.col("kind") == kind).groupBy(name).agg(key.alias("key"), n.alias("n")).select("rname", F.lit(what).alias("kind"), "key", "n")
    none, zero = F.max(F.lit(None).cast("long")), F.max(F.lit(0).cast("long"))
    bins = i.where("kind = 'chunk'").select(name, F.lit("bin").alias("kind"), F.col("key").cast("long").alias("key"), F.lit(None).cast("long").alias("n")).distinct()
    return bins.unionByName(by("line", "windows", F.max("key").cast("long") + 1, none)).unionByName(by("count", "mapped", zero, F.sum("begin"))).unionByName(by("loose", "loose", zero, F.sum("begin")))


@query("select ref_id, rname, cast(length(seq) as int) as length, md5(upper(seq)) as md5 from ref", "ref")
def ref_md5(spark, d):
    return refs.checksums(ref(spark, d))


@query("select rname, substring(seq, 101, 50) as seq from ref where rname = 'chr2'", "ref")
def ref_region(spark, d):
    return refs.strict_region(ref(spark, d), "chr2", 101, 150)


@query("select rname, substring(seq, 1990) as seq from ref where rname = 'chr3'", "ref")
def ref_region_clipped(spark, d):
    return refs.region(ref(spark, d), "chr3", 1990, 2_000_000_000)


@query("""select i as id, rname, md5(upper(substring(seq, i * 200 + 1, 200))) as found, i % 3 <> 0 as ok from (select rname, seq, cast(unnest(range(0, (length(seq) + 199) // 200)) as int) as i from ref) s""", "ref")
def slice_md5_check(spark, d):
    """Checksums of stretches of 200 letters over whole contigs, every third of them wrong."""
    r = ref(spark, d)
    s = r.select("rname", "seq", F.explode(F.expr("sequence(0, cast((length(seq) + 199) div 200 - 1 as int))")).alias("id"))
    span = F.least(F.lit(200), F.length("seq") - F.col("id") * 200).alias("span")
    spans = s.select("id", "rname", (F.col("id") * 200 + 1).alias("start"), span, F.when(F.col("id") % 3 == 0, "bad").otherwise(F.md5(F.upper(F.expr("substring(seq, id * 200 + 1, 200)")))).alias("md5"))
    return refs.check_spans(spans, r)


@query("""select rname, cast(length(seq) as int) as length, md5(upper(seq)) as md5, ref_id = 1 as was_wrong, concat('http://host/', md5(upper(seq))) as uri from ref union all select 'chrX', 7, 'abc', false, null""", "ref")
def sq_fix(spark, d):
    r = ref(spark, d)
    listed = r.select("rname", F.lit(1).alias("length"), F.when(F.col("ref_id") == 1, "wrong").when(F.col("ref_id") == 2, F.md5(F.upper("seq"))).alias("md5"))
    extra = spark.range(1).select(F.lit("chrX").alias("rname"), F.lit(7).alias("length"), F.lit("abc").alias("md5"))
    return refs.fix_dictionary(listed.union(extra), r, "http://host/%s").withColumn("uri", F.when(F.col("rname") != "chrX", F.col("uri")))


@query("select * from (values ('chr1', 'chr1'), ('1', 'chr1'), ('M', 'MT'), ('MT', 'MT'), ('chrM', 'MT'), ('chr9', cast(null as varchar)), ('5', 'chr5')) t(asked, rname)")
def name_variants(spark, d):
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, ("chr1", "1", "M", "MT", "chrM", "chr9", "5")))).alias("asked"))
    known = ref(spark, d).select("rname").union(spark.range(1).select(F.lit("MT")))
    return refs.name_variants(asked, known)


@query("""select rname, cast(length(seq) as int) as length, cast(coalesce(sum(2 + length(rname) + length(seq) + ceil(length(seq) / 60.0)) over (order by ref_id rows between unbounded preceding and 1 preceding), 0) + 2 + length(rname) as bigint) as start,
    60 as line_bases, 61 as line_bytes from ref""", "ref")
def fai_build(spark, d):
    return refs.fasta_index(ref(spark, d))


@query("""select rname, '>' || rname || ' ' || md5(upper(seq)) || chr(10) || string_agg(substring(seq, i * 80 + 1, 80), chr(10) order by i) || chr(10) as text
    from (select rname, seq, unnest(generate_series(0, (length(seq) - 1) // 80)) as i from ref) x group by rname, seq""", "ref")
def fasta_wrapped(spark, d):
    return refs.wrapped(ref(spark, d))


@query("select rname, cast(length(seq) as int) as length, 'file:///refs/' || rname || '.fa' as uri, md5(upper(seq)) as md5 from ref", "ref")
def repo_round_trip(spark, d):
    return refs.parse_repo(refs.repo_lines(ref(spark, d), "/refs"))


@query("select md5(cast(n_regionkey as varchar)) as md5, max(n_nationkey) as i from nation group by n_regionkey")
def repo_latest(spark, d):
    e = table(spark, d, "nation").select(F.md5(F.col("n_regionkey").cast("string")).alias("md5"), F.col("n_nationkey").alias("i"))
    return refs.repo_map(e.withColumn("v", F.col("i")), "md5", "i").select("md5", F.col("v").alias("i"))


@query("select md5(cast(n_nationkey as varchar)) as md5, n_nationkey as i from nation")
def ref_cache_add(spark, d):
    e = table(spark, d, "nation").select(F.md5(F.col("n_nationkey").cast("string")).alias("md5"), F.col("n_nationkey").alias("i"))
    return refs.add_missing(e.where("i < 10"), e)


@query("select p_partkey, 3 as n, least(p_size, 60, 61 + p_size % 7) as first, 61 + p_size % 7 as last from part")
def mask_int(spark, d):
    line = F.concat_ws(" ", F.lit(60), F.col("p_size"), F.col("p_size") % 7 + 61)
    return masks.describe(table(spark, d, "part").select("p_partkey", masks.from_integers(line).alias("mask"))).select("p_partkey", "n", "first", "last")


@query("""select p_partkey, 'letters' as kind, rtrim(replace(translate(m, '01', '_x'), ' ', ''), '_') as back, m[5:5] = '1' as fifth from (select p_partkey, right('0000000000' || bin(p_size + 1), 10) as m from part) x""")
def mask_fasta(spark, d):
    from readloom.operators.filters import with_mask

    line = F.translate(F.lpad(F.bin(F.col("p_size") + 1), 10, "0"), "01", "_x")
    m = table(spark, d, "part").select("p_partkey", masks.detect(line).alias("kind"), masks.from_letters(line).alias("mask"), F.lit(5).alias("pos"))
    return with_mask(m).select("p_partkey", "kind", masks.render(F.col("mask")).alias("back"), F.col("is_masked").alias("fifth"))


_EVIDENCE = {
    "IntervalId": "c_custkey", "Chromosome": "'chr' || cast(c_nationkey % 5 + 1 as string)", "Slide": "'GS' || cast(c_custkey % 9 as string)", "Lane": "'L0' || cast(c_custkey % 3 as string)", "FileNumInLane": "c_custkey % 4",
    "DnbOffsetInLaneFile": "c_custkey", "AlleleIndex": "0", "Side": "case when c_custkey % 2 = 0 then 'L' else 'R' end", "Strand": "case when c_custkey % 3 = 0 then '-' else '+' end", "OffsetInAllele": "1", "AlleleAlignment": "'10M'",
    "OffsetInReference": "c_custkey * 3 % 1000", "ReferenceAlignment": "'35M'", "MateOffsetInReference": "c_custkey * 3 % 1000 + 300", "MateReferenceAlignment": "'5M2B30M'", "MateStrand": "case when c_custkey % 5 = 0 then '-' else '+' end",
    "MappingQuality": "'A'", "MappingQualityScore": "0", "ScoreAllele0": "1", "ScoreAllele1": "2", "ScoreAllele2": "''",
}


@query("""with e as (select 'GS' || cast(c_custkey % 9 as varchar) || '-L0' || cast(c_custkey % 3 as varchar) || '-' || cast(c_custkey % 4 as varchar) || ':' || cast(c_custkey as varchar) as qname, 'chr' || cast(c_nationkey % 5 + 1 as varchar) as rname,
      c_custkey % 2 = 0 as l, c_custkey % 3 = 0 as m, c_custkey % 5 = 0 as mm, cast(c_custkey * 3 % 1000 as int) as o from customer)
    select qname, cast(3 + case when m then 16 else 0 end + case when mm then 32 else 0 end + case when l then 64 else 128 end as int) as flag, rname, o + 1 as pos, 32 as mapq, '35M' as cigar, case when l then 'L' else 'R' end as side from e
    union all select qname, cast(3 + case when mm then 16 else 0 end + case when m then 32 else 0 end + case when l then 128 else 64 end as int), rname, o + 301, 32, '5M2B30M', case when l then 'R' else 'L' end from e""")
def evidence_reads(spark, d):
    e = table(spark, d, "customer").selectExpr(*(f"cast({v} as string) as {k}" for k, v in _EVIDENCE.items()))
    return evidence.records(e)


#: cigar, what it packs to, its stretches, and the letters before and in its step back.
_OVERLAPS = [
    ("10M3B22M", "29M", "7S3G19S", 10, 3), ("10M2B5M2I5D15M", "15M3D15M", "8S2G3S2S15S", 10, 2), ("5M5I2D22M", "5M2M3I22M", "5S5S22S", 32, 0), ("10M2P5D22M", "10M3D2N22M", "10S22S", 32, 0),
    ("8M4B24M", "28M", "4S4G20S", 8, 4), ("10M4B2M1D2M18M", "28M", "6S4G18S", 10, 4), ("10M2I5D20M", "12M3D20M", "10S2S20S", 32, 0), ("16M3B3M5N13M", "16M5N13M", "13S3G13S", 16, 3),
]


def _overlap_sql() -> str:
    shapes = ", ".join(f"({i}, '{p}', '{gc}', {n}, {b})" for i, (_, p, gc, n, b) in enumerate(_OVERLAPS))
    pick = lambda c: f"coalesce(string_agg(case when substring(qual, n - b + i, 1) > substring(qual, n + i, 1) then substring({c}, n - b + i, 1) else substring({c}, n + i, 1) end, '' order by i) filter (where i > 0), '')"
    whole = lambda c: f"substring(any_value({c}), 1, any_value(n - b)) || {pick(c)} || substring(any_value({c}), any_value(n + b) + 1)"
    return f"""select rec_idx, any_value(packed) as cigar, {whole('seq')} as seq, {whole('qual')} as qual, any_value(gc) as gc, substring(any_value(seq), any_value(n - b) + 1, any_value(2 * b)) as gs, substring(any_value(qual), any_value(n - b) + 1, any_value(2 * b)) as gq
      from (select r.*, o.*, unnest(generate_series(least(1, b), b)) as i from reads r join (values {shapes}) o(k, packed, gc, n, b) on r.rec_idx % {len(_OVERLAPS)} = o.k where length(seq) = 32) x group by rec_idx"""


@query(_overlap_sql(), "reads")
def cg_split_pack(spark, d):
    shape = F.element_at(F.array(*(F.lit(c) for c, *_ in _OVERLAPS)), (F.col("rec_idx") % len(_OVERLAPS) + 1).cast("int"))
    return evidence.split_overlaps(reads(spark, d).where("length(seq) = 32").withColumn("cigar", shape))


# ---- streams

def _events(spark, d):
    """All reads as events, a second apart; each ninth has a name of its own, so it and its mate are orphans."""
    name = F.expr("case when rec_idx % 9 = 8 then concat(qname, '.x') else qname end")
    return reads(spark, d).select(name.alias("qname"), "rec_idx", "rname", "pos", "mapq", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("rec_idx"))).alias("ts"))


_NAMES = "(select *, case when rec_idx % 9 = 8 then qname || '.x' else qname end as name from reads)"


@query(f"select name as qname, min(rec_idx) as rec_a, case when count(*) = 2 then max(rec_idx) else -1 end as rec_b from {_NAMES} l group by name", "reads")
def stream_pair_collate(spark, d):
    from readloom.streaming import collate

    return collate.replay(spark, _events(spark, d), lambda s: collate.pair_stream(s, "30 days"), "append").where("qname is not null")


@query(f"select name as qname, rec_idx, mapq from {_NAMES} l qualify row_number() over (partition by name order by mapq desc, rec_idx) = 1", "reads")
def stream_dedup(spark, d):
    from readloom.streaming import collate

    return collate.replay(spark, _events(spark, d), lambda s: collate.dedup_stream(s, "30 days"), "append").where("qname is not null").select("qname", "rec_idx", "mapq")


@query("select rname, cast((pos - 1) // 100 as bigint) as tile, count(*) as n from reads where pos > 0 group by 1, 2", "reads")
def stream_pileup(spark, d):
    from readloom.streaming import collate

    return collate.replay(spark, _events(spark, d), collate.pileup_stream, "complete")


@query(f"select name as qname, min(rec_idx) as rec_a, case when count(*) = 2 then max(rec_idx) else -1 end as rec_b from {_NAMES} l group by name", "reads")
def stream_pair_bounded(spark, d):
    """Mates with at most 100 open names; the overflow is put together afterwards."""
    from readloom.streaming import bounded, collate

    with bounded.stateful(spark):
        emitted = collate.replay(spark, _events(spark, d), lambda s: bounded.pair_bounded(s, 100, 4, "30 days"), "append")
    return bounded.reconciled(emitted)


@query("select rname, cast(ref_pos as int) as ref_pos, count(*) as coverage from (select rname, unnest(range(pos, aln_end + 1)) as ref_pos from reads where (flag & 4) = 0 and aln_end >= pos) x group by 1, 2", "reads")
def stream_coverage(spark, d):
    """Coverage of records that come in order of contig and position: a position leaves when the stream has passed it."""
    from readloom.operators.cuts import numbered
    from readloom.streaming import bounded, collate

    r = numbered(reads(spark, d).where("flag & 4 = 0").select("flag", "rname", "pos", "aln_end"), ["rname", "pos"], "rec_idx")
    r = r.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("rec_idx")))
    with bounded.stateful(spark):
        return collate.replay(spark, r, lambda s: bounded.coverage_stream(s, "30 days"), "append", ordered=True)


# ---- data sources

_CONTIGS = [(f"chr{i}", 3_000_000) for i in range(1, 6)]


def _written(spark, d, single, stretch=997):
    """The reads in order of place, stretched over longer contigs, written as BAM; and the folder or file."""
    import json
    import uuid

    from readloom.operators.cuts import shared_folder
    from readloom.sources import datasource

    datasource.register(spark)
    r = reads(spark, d).withColumns({"pos": F.expr(f"cast(if(pos > 0, (pos - 1) * {stretch} + 1, 0) as int)"), "rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0)})
    order = [F.when(F.col("rname") == "*", 1).otherwise(0), "rname", "pos", "rec_idx"]
    at = f"{shared_folder(spark)}/bam-{uuid.uuid4().hex}" + (".bam" if single else "")
    w = r.repartitionByRange(4, *order).sortWithinPartitions(*order).write.format("readloom-bam").option("refs", json.dumps(_CONTIGS)).option("single", str(single).lower())
    w.mode("overwrite").save(at)
    return at


@query("select qname, flag, rname, cast(case when pos > 0 then (pos - 1) * 997 + 1 else 0 end as int) as pos, mapq, cigar, seq, qual from reads", "reads")
def bam_written_and_read(spark, d):
    """All reads as one BAM file, written by tasks and a commit, and read again."""
    return spark.read.format("readloom-bam").load(_written(spark, d, True)).select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual")


@query("select qname, rname, cast((pos - 1) * 997 + 1 as int) as pos from reads where rname = 'chr2' and (pos - 1) * 997 + 1 between 400000 and 900000", "reads")
def bam_region_pushed(spark, d):
    """A stretch of a contig from indexed BAM files: the filters choose what is read."""
    from readloom.sources import bai, datasource

    at = _written(spark, d, False)
    datasource.write_indexes(bai.to_bai(bai.index_rows(spark, f"{at}/*.bam")))
    return spark.read.format("readloom-bam").load(at).where("rname = 'chr2' and pos >= 400000 and pos <= 900000").select("qname", "rname", "pos")


@query("""select rec_idx // 1000 * 1000 as container, cast(row_number() over (partition by rname, rec_idx // 1000 order by rec_idx // 500) - 1 as int) as slice, ref, start, span, n, names_md5 from (
    select rname, rec_idx // 500 * 500 as rec_idx, cast(right(rname, 1) as int) - 1 as ref, cast(min(pos) as int) as start, cast(max(aln_end) - min(pos) + 1 as int) as span, count(*) as n, md5(string_agg(qname, chr(10) order by rec_idx)) as names_md5
    from reads where (flag & 4) = 0 group by rname, rec_idx // 500) x""", "reads")
def cram_framing(spark, d):
    """Placed reads in containers of one contig and of 1,000 record numbers, two slices to each: written as bytes by tasks and parsed again."""
    from readloom.sources import cram_blocks

    ref_id = F.expr("cast(right(rname, 1) as int) - 1")
    r = reads(spark, d).where("flag & 4 = 0")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_idx", "qname"))), lambda x: x["qname"]), "\n").cast("binary")
    g = r.groupBy(ref_id.alias("ref"), F.expr("rec_idx div 500").alias("part")).agg(
        F.min("pos").alias("start"), (F.max("aln_end") - F.min("pos") + 1).cast("int").alias("span"), F.count("*").cast("int").alias("n"), F.sum(F.length("seq")).alias("bases"), F.min("rec_idx").alias("first"), names.alias("data"),
    )
    slices = g.withColumns({"container": F.expr("(part div 2) * 10 + ref"), "slice": F.col("part")})
    out = cram_blocks.parsed(cram_blocks.containers_of(slices))
    return out.select(F.expr("container div 10 * 1000").alias("container"), "slice", "ref", "start", "span", "n", F.md5("data").alias("names_md5"))


@query("select rname, cast(i * 700 + 1 as bigint) as start, cast(i * 700 + 900 as bigint) as stop, upper(substring(seq, i * 700 + 1, 900)) as seq from (select rname, seq, unnest(range(0, (length(seq) + 699) // 700)) as i from ref) x", "ref")
def ref_by_ur(spark, d):
    """Stretches over all contigs, each from the FASTA file that its header line names: three files with an index each."""
    import uuid

    from readloom.operators.cuts import shared_folder
    from readloom.sources import datasource, fasta

    r = ref(spark, d)
    home = f"{shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    ur = F.concat(F.lit(f"{home}/"), (F.col("ref_id") % 3).cast("string"), F.lit(".fa")).alias("ur")
    texts, indexes = [], []
    joined = lambda of, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*of, line.alias("line")))), lambda x: x["line"]), "").cast("binary").alias("content")
    for k in range(3):
        own, path = r.where(F.col("ref_id") % 3 == k), F.lit(f"{home}/{k}.fa")
        fasta_line = F.concat(F.lit(">"), "rname", F.lit("\n"), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n"), F.lit("\n"))
        texts.append(own.groupBy(path.alias("path")).agg(joined(["ref_id"], fasta_line)))  # five contigs in all
        index_line = F.concat(F.concat_ws("\t", "rname", "length", "start", "line_bases", "line_bytes"), F.lit("\n"))
        indexes.append(refs.fasta_index(own).groupBy(F.concat(path, F.lit(".fai")).alias("path")).agg(joined(["start"], index_line)))
    datasource.put(functools.reduce(DataFrame.union, texts + indexes))
    lines = r.select(F.concat(F.lit("@SQ\tSN:"), "rname", F.lit("\tLN:"), F.length("seq"), F.lit("\tUR:"), ur).alias("value"))
    wanted = r.select("rname", F.explode(F.expr("sequence(0L, (length(seq) + 699) div 700 - 1)")).alias("i")).selectExpr("rname", "i * 700 + 1 as start", "i * 700 + 900 as stop")
    return fasta.by_header(fasta.dictionary_of(lines), wanted, 8)


@query("select rname, md5(seq) as whole, upper(substring(seq, 1001, 500)) as part from ref", "ref")
def sealed_round_trip(spark, d):
    """Contigs as sealed files of small blocks: opened whole, and from letter 1,001 on for 500 letters."""
    import uuid

    from readloom.operators.cuts import shared_folder
    from readloom.sources import datasource, sealed

    home, key = f"{shared_folder(spark)}/sealed-{uuid.uuid4().hex}", "0123456789abcdef"
    datasource.put(ref(spark, d).select(F.concat(F.lit(f"{home}/plain/"), "rname").alias("path"), F.col("seq").cast("binary").alias("content")))
    sealed.seal(spark, f"{home}/plain", f"{home}/sealed", key, block=300, blocks=2)
    name = F.element_at(F.split("name", "/"), -1).alias("rname")
    pieces = F.array_sort(F.collect_list(F.struct("begin", F.col("content").cast("string").alias("c"))))
    text = F.array_join(F.transform(pieces, lambda x: x["c"]), "")
    whole = sealed.opened(spark, f"{home}/sealed", key).groupBy(name).agg(F.md5(text).alias("whole"))
    part = sealed.opened(spark, f"{home}/sealed", key, 1000, 1500).groupBy(name).agg(F.upper(text).alias("part"))
    return whole.join(part, "rname")
