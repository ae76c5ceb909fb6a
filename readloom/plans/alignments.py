"""Queries on aligned bases, scores, mates, merging and comparing."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import cigar, pair
from readloom.operators import diff, features, filters, lossy, merge, pairing, pileup
from readloom.plans.fixtures import aligned, perturbed, reads, ref, split_reads, table
from readloom.plans.registry import query


@query("select rec_idx, op, read_pos, ref_pos, base, ref_base from aligned where op in ('M','I','S','D','N')", "aligned")
def aligned_bases(spark, d):
    return aligned(spark, d).select("rec_idx", "op", "read_pos", "ref_pos", "base", "ref_base")


@query("select rname, ref_pos, count(*) as coverage from aligned where ref_pos is not null group by 1, 2", "aligned")
def coverage(spark, d):
    return pileup.coverage(reads(spark, d))


@query("select rname, ref_pos, count(*) as mismatches from aligned where op in ('M','=','X') and base <> ref_base group by 1, 2", "aligned")
def mismatch_pileup(spark, d):
    return pileup.mismatches(reads(spark, d), ref(spark, d))


_COUNTS = """select rname, ref_pos, ref_base, least(sum(case when base='A' then 1 else 0 end), {c}) as n_a, least(sum(case when base='C' then 1 else 0 end), {c}) as n_c,
    least(sum(case when base='G' then 1 else 0 end), {c}) as n_g, least(sum(case when base='T' then 1 else 0 end), {c}) as n_t from aligned where op in ('M','=','X') group by 1, 2, 3"""


@query(f"select rname, ref_pos, ref_base, cast(n_a as bigint) as n_a, cast(n_c as bigint) as n_c, cast(n_g as bigint) as n_g, cast(n_t as bigint) as n_t from ({_COUNTS.format(c=3)}) x", "aligned")
def base_counts(spark, d):
    return pileup.base_counts(pileup.letter_counts(reads(spark, d).where("flag & 4 = 0"), ref(spark, d)), 3).select("rname", "ref_pos", "ref_base", *(F.col(f"n_{b}").cast("long") for b in "acgt"))


_SEEN = _COUNTS.format(c=15).replace("from aligned where", "from (select * replace (case when rec_idx % 3 = 0 and ref_pos % 10 = 0 then 'A' else base end as base) from aligned) y where")


@query(f"""select rname, ref_pos from ({_SEEN}) x where ((ref_base <> 'A' and n_a >= 2) or (ref_base <> 'C' and n_c >= 2) or (ref_base <> 'G' and n_g >= 2) or (ref_base <> 'T' and n_t >= 2))
    and n_a + n_c + n_g + n_t <= 10""", "aligned")
def keep_positions(spark, d):
    """Every third read is given an A at each tenth position, so some positions have another base than the contig's twice."""
    placed = reads(spark, d).where("flag & 4 = 0").withColumn("third", F.expr("rec_idx % 3 = 0"))
    seen = pileup.letter_counts(placed, ref(spark, d), "third").withColumn("base", F.expr("case when third and ref_pos % 10 = 0 then 'A' else base end"))
    return pileup.keep_positions(pileup.base_counts(seen, 15), 2, 10).select("rname", "ref_pos")


@query("select rname, min(pos) as first_pos, max(aln_end) as last_pos, count(*) as n from reads group by rname", "reads")
def ref_spans(spark, d):
    return pileup.ref_spans(reads(spark, d))


@query("select rec_idx // 1000 as slice, rname, min(pos) as first_pos, max(aln_end) as last_pos, count(*) as n from reads group by 1, 2", "reads")
def slice_spans(spark, d):
    return pileup.ref_spans(reads(spark, d).withColumn("slice", F.expr("rec_idx div 1000")), "slice")


@query("select slice, n_refs > 1 as multi_ref from (select rec_idx // 1000 as slice, count(distinct rname) as n_refs from reads group by 1) x", "reads")
def multi_ref_slices(spark, d):
    return reads(spark, d).groupBy(F.expr("rec_idx div 1000").alias("slice")).agg((F.min("rname") != F.max("rname")).alias("multi_ref"))


@query("""select rec_idx, cast(sum(case when op in ('I','D') then 1 when op in ('M','=','X') and base <> ref_base then 1 else 0 end) as int) as nm from aligned group by 1""", "aligned")
def nm_tag(spark, d):
    return pileup.md_nm(reads(spark, d), ref(spark, d), with_md=False)


_MD = """with x as (select rec_idx, op, read_pos, ref_pos, base, ref_base from aligned where op in ('M','=','X','D') and ref_base <> ''),
  y as (select *, case when op = 'D' or base <> ref_base then 1 else 0 end as brk from x),
  z as (select *, row_number() over w as n, lag(op) over w as prev_op, lag(ref_pos) over w as prev_pos from y window w as (partition by rec_idx order by ref_pos)),
  b as (select *, max(case when brk = 1 then n end) over (partition by rec_idx order by n rows between unbounded preceding and 1 preceding) as last_brk from z),
  t as (select rec_idx, n, case when op = 'D' and prev_op = 'D' and prev_pos = ref_pos - 1 then ref_base
      else cast(n - 1 - coalesce(last_brk, 0) as varchar) || case when op = 'D' then '^' else '' end || ref_base end as part from b where brk = 1),
  e as (select rec_idx, count(*) - coalesce(max(case when brk = 1 then n end), 0) as tail from z group by rec_idx)
select e.rec_idx, coalesce(p.md, '') || cast(e.tail as varchar) as md from e left join (select rec_idx, string_agg(part, '' order by n) as md from t group by rec_idx) p on p.rec_idx = e.rec_idx"""


@query(_MD, "aligned")
def md_tag(spark, d):
    return pileup.md_nm(reads(spark, d), ref(spark, d)).select("rec_idx", "md")


@query("""select rec_idx, substring(seq, 1, 20) as seq, substring(qual, 1, 20) as qual, case cigar when '32M' then '20M' when '10M2D22M' then '10M2D10M' when '5S27M' then '5S15M' when '12M3I17M' then '12M3I5M'
    when '16M5N16M' then '16M5N4M' else '*' end as cigar from reads""", "reads")
def trim_read(spark, d):
    return features.trim(reads(spark, d), 20).select("rec_idx", "cigar", "seq", "qual")


_FEATURES = """select rec_idx, op, cast(q0 + 1 as int) as pos, len, case when op in ('S','I') then substring(seq, q0 + 1, len) end as bases from placed where op in ('S','I','D','N','H','P')
  union all select rec_idx, 'X', read_pos, 1, base from aligned where op in ('M','=','X') and base <> ref_base"""


@query(_FEATURES, "aligned")
def read_features(spark, d):
    return features.read_features(reads(spark, d), ref(spark, d)).select("rec_idx", "op", "pos", "len", "bases")


@query("select rec_idx, seq from reads where (flag & 4) = 0", "reads")
def restore_bases(spark, d):
    r, s = reads(spark, d), ref(spark, d)
    return features.restore_bases(r, features.read_features(r, s), s)


@query("select rec_idx, cigar from reads where (flag & 4) = 0", "reads")
def cigar_from_features(spark, d):
    r = reads(spark, d)
    f = features.feature_arrays(features.read_features(r, ref(spark, d)))
    none = F.array().cast("array<struct<pos:int,idx:int,op:string,len:int,bases:string>>")
    return r.where("flag & 4 = 0").join(f, "rec_idx", "left").select("rec_idx", features.cigar_of(F.coalesce("features", none), F.length("seq")).alias("cigar"))


@query("""select rec_idx, string_agg(cast(32 - p - 1 as varchar) || op, ',' order by p desc, op desc) as turned from (select rec_idx, read_pos - 1 as p, 'X' as op from aligned where op = 'M' and base <> ref_base) x group by rec_idx""", "aligned")
def reversed_features(spark, d):
    f = features.feature_arrays(features.read_features(reads(spark, d), ref(spark, d)).where("op = 'X'"))
    zero = F.transform("features", lambda x: F.struct((x["pos"] - 1).alias("pos"), x["op"].alias("op")))
    turned = features.reversed_positions(zero, F.lit(32))
    return f.select("rec_idx", F.array_join(F.transform(turned, lambda x: F.concat(x["pos"].cast("string"), x["op"])), ",").alias("turned"))


@query("""select rec_idx, string_agg(case when i % 4 = 0 then substring(qual, i, 1) else '?' end, '' order by i) as qual from (select rec_idx, qual, unnest(generate_series(1, length(seq))) as i from reads) x group by rec_idx""", "reads")
def restore_scores(spark, d):
    r = reads(spark, d)
    kept = r.select("rec_idx", F.explode(F.sequence(F.lit(4), F.lit(32), F.lit(4))).alias("read_pos"), "qual").select("rec_idx", "read_pos", (F.ascii(F.expr("substring(qual, read_pos, 1)")) - 33).alias("score"))
    return features.restore_scores(r, kept)


@query("select exists(select 1 from aligned where op = 'M' and base <> ref_base) as found", "aligned")
def substitution_exists(spark, d):
    f = features.read_features(reads(spark, d), ref(spark, d)).where("op = 'X'").limit(1)
    return f.agg((F.count("*") > 0).alias("found"))


@query("select sum(len) as bases, sum(n) as differences, sum(len) < 3 * sum(n) as abnormal from (select cast(length(seq) as bigint) as len, 0 as n from reads where (flag & 4) = 0 union all select 0, 1 from aligned where op = 'M' and base <> ref_base) x", "aligned")
def mismatch_ratio(spark, d):
    from readloom.operators.stats import mismatch_ratio_warning

    a = reads(spark, d).where("flag & 4 = 0").select(F.length("seq").cast("long").alias("bases"), F.lit(0).cast("long").alias("differences"))
    b = pileup.substitutions(reads(spark, d), ref(spark, d)).select(F.lit(0).cast("long").alias("bases"), F.lit(1).cast("long").alias("differences"))
    return mismatch_ratio_warning(a.union(b))


# ---- mates

_LOST = "(select *, case when rec_idx % 9 = 8 then qname || '.x' else qname end as name from reads)"
_BY = f"select name as qname, min(rec_idx) as rec_a, max(rec_idx) as rec_b, count(*) as n from {_LOST} l group by name"


def _some(spark, d):
    """All reads; each ninth has a name of its own, so it and its mate are orphans."""
    return reads(spark, d).withColumn("qname", F.expr("case when rec_idx % 9 = 8 then concat(qname, '.x') else qname end"))


@query(f"select qname, rec_a, rec_b from ({_BY}) x where n = 2", "reads")
def mate_pairs(spark, d):
    return pairing.mate_pairs(_some(spark, d))


@query(f"select rec_a as rec_idx from ({_BY}) x where n = 1", "reads")
def orphans(spark, d):
    return pairing.orphans(_some(spark, d)).select("rec_idx")


@query(f"select rec_idx, case when n = 1 then 0 when (flag & 64) <> 0 then 1 else 2 end as stream from {_LOST} r join ({_BY}) x on r.name = x.qname", "reads")
def pair_collate(spark, d):
    return pairing.collated(_some(spark, d))


@query("select rec_idx, rec_idx + 1 as mate_idx from reads where rec_idx % 2 = 0", "reads")
def mate_link_by_offset(spark, d):
    return pairing.link_by_offset(reads(spark, d), F.expr("case when rec_idx % 2 = 0 then 0 end"))


_MATES = """select a.rec_idx, a.flag as af, b.flag as bf, a.rname as ar, b.rname as br, a.pos as ap, b.pos as bp, a.aln_end as ae, b.aln_end as be, a.mapq as aq, b.mapq as bq,
    (a.flag & 4) = 0 and (b.flag & 4) = 0 and a.rname = b.rname as joint from split_reads a
    join (select * from split_reads qualify row_number() over (partition by qname, flag & 192 order by (flag & 2304) <> 0, rec_idx) = 1) b on a.qname = b.qname and (a.flag & 192) <> (b.flag & 192)"""
_FIVE = "case when joint then (case when (bf & 16) <> 0 then be else bp end) - (case when (af & 16) <> 0 then ae else ap end) + case when (case when (bf & 16) <> 0 then be else bp end) >= (case when (af & 16) <> 0 then ae else ap end) then 1 else -1 end else 0 end"
_OUTER = "case when joint then (greatest(ae, be) - least(ap, bp) + 1) * case when ap < bp or (ap = bp and (af & 64) <> 0) then 1 else -1 end else 0 end"


@query(f"select r.rec_idx, coalesce(br, '*') as rnext, coalesce(bp, 0) as pnext, coalesce({_FIVE}, 0) as tlen from split_reads r left join ({_MATES}) m on m.rec_idx = r.rec_idx", "split_reads")
def mate_info(spark, d):
    return pairing.mate_info(split_reads(spark, d)).select("rec_idx", "rnext", "pnext", "tlen")


@query(f"select rec_idx, {_FIVE} as tlen from ({_MATES}) m", "split_reads")
def tlen_5prime(spark, d):
    return pairing.mates(split_reads(spark, d)).select("a.rec_idx", pair.five_prime_size(F.col("a"), F.col("b")).alias("tlen"))


@query(f"select rec_idx, {_OUTER} as tlen from ({_MATES}) m", "split_reads")
def tlen_outer(spark, d):
    return pairing.mates(split_reads(spark, d)).select("a.rec_idx", pair.outer_size(F.col("a"), F.col("b")).alias("tlen"))


@query(f"""select rec_idx, case when (af & 4) <> 0 and (bf & 4) = 0 then br else ar end as rname, case when (af & 4) <> 0 and (bf & 4) = 0 then bp else ap end as pos,
    case when (bf & 4) <> 0 and (af & 4) = 0 then ar else br end as rnext, case when (bf & 4) <> 0 and (af & 4) = 0 then ap else bp end as pnext,
    case when (bf & 4) = 0 then bq end as mate_mapq, (bf & 16) <> 0 as mate_reverse, {_OUTER} as tlen from ({_MATES}) m""", "split_reads")
def loose_mate_info(spark, d):
    return pairing.loose_mate_info(split_reads(spark, d))


@query("""select qname, first_pos, last_pos, case when low = high and first_pos is not null then last_pos - first_pos + 1 else 0 end as extent from (
    select qname, min(case when (flag & 4) = 0 then pos end) as first_pos, max(case when (flag & 4) = 0 then aln_end end) as last_pos, min(rname) as low, max(rname) as high from reads group by qname) x""", "reads")
def template_extent(spark, d):
    return pairing.template_extent(reads(spark, d))


@query("select rec_idx, case when rec_idx = last then first else rec_idx + 1 end as next_idx from (select rec_idx, min(rec_idx) over w as first, max(rec_idx) over w as last from reads window w as (partition by qname)) x", "reads")
def next_segment(spark, d):
    return pairing.next_segment(reads(spark, d))


@query(f"""select r.rec_idx, case when ok then m.mate end as mate_idx, not coalesce(ok, false) as detached from reads r left join (
    select a.rec_idx, b.rec_idx as mate, a.rec_idx % 10 <> 0 and b.rec_idx % 10 <> 0 as ok from reads a join reads b on a.qname = b.qname and a.rec_idx <> b.rec_idx and (a.flag & 256) = (b.flag & 256)) m on m.rec_idx = r.rec_idx""", "reads")
def mate_link_by_name(spark, d):
    # every tenth record's mate position is wrong, which detaches both
    return pairing.linked_by_name(pairing.mate_info(reads(spark, d)).withColumn("pnext", F.expr("case when rec_idx % 10 = 0 then pnext + 1 else pnext end")))


@query(f"""select rec_idx, (af & 1) <> 0 and (bf & 1) <> 0 and ((af & 8) <> 0) = ((bf & 4) <> 0) and ((bf & 8) <> 0) = ((af & 4) <> 0) and ((af & 32) <> 0) = ((bf & 16) <> 0) and ((bf & 32) <> 0) = ((af & 16) <> 0)
    and ((af & 2) <> 0) = ((bf & 2) <> 0) as consistent from ({_MATES}) m""", "split_reads")
def mate_flag_check(spark, d):
    return pairing.flag_check(split_reads(spark, d))


@query(f"select cast(count(*) as bigint) as n from ({_MATES}) m where ((af & 32) <> 0) <> ((bf & 16) <> 0) or ((af & 8) <> 0) <> ((bf & 4) <> 0)", "split_reads")
def mate_flag_differences(spark, d):
    from readloom.functions.flags import has

    m = pairing.mates(split_reads(spark, d))
    f, g = F.col("a.flag"), F.col("b.flag")
    return m.where((has(f, 32) != has(g, 16)) | (has(f, 8) != has(g, 4))).agg(F.count("*").alias("n"))


# ---- merging

def _sources(spark, d):
    r = reads(spark, d).drop("tags")
    return {"s0": r.where("rec_idx % 2 = 0"), "s1": r.where("rec_idx % 2 = 1")}


@query("select concat('s', cast(rec_idx % 2 as varchar), '.', qname) as qname, rec_idx, concat('s', cast(rec_idx % 2 as varchar)) as source, rname, pos from reads", "reads")
def merge_sources(spark, d):
    return merge.merged(_sources(spark, d)).select("qname", "rec_idx", "source", "rname", "pos")


@query("""select rec_idx, rname, pos, row_number() over (order by ref_id nulls last, pos, rec_idx % 2, rec_idx) as place from (select r.rec_idx, r.rname, r.pos, f.ref_id from reads r left join ref f on f.rname = r.rname) x""", "reads")
def merge_sorted(spark, d):
    return merge.merge_places(merge.merged(_sources(spark, d)).select("rec_idx", "rname", "pos", "source"), ref(spark, d)).select("rec_idx", "rname", "pos", "place")


@query("""select id, min(src) as src from (select concat('rg', cast(n_nationkey % 7 as varchar)) as id, 0 as src from nation where n_nationkey < 12 union all select concat('rg', cast(n_nationkey % 10 as varchar)), 1 from nation) x group by id""")
def merge_header(spark, d):
    n = table(spark, d, "nation")
    rows = n.where("n_nationkey < 12").select(F.concat(F.lit("rg"), F.col("n_nationkey") % 7).alias("id"), F.lit(0).alias("src")).union(n.select(F.concat(F.lit("rg"), F.col("n_nationkey") % 10), F.lit(1)))
    return merge.header_union(rows, ["id"], ["src"])


@query("""select i, case when n > 1 then id || cast(k as varchar) else id end as unique_id from (select n_nationkey as i, n_name_ as id, count(*) over (partition by n_name_) as n, row_number() over (partition by n_name_ order by n_nationkey) as k
    from (select n_nationkey, concat('file', cast(n_nationkey * n_nationkey % 11 as varchar), '.bam') as n_name_ from nation) a) b""")
def merge_collisions(spark, d):
    s = table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.concat(F.lit("file"), F.expr("n_nationkey * n_nationkey % 11"), F.lit(".bam")).alias("id"))
    return merge.distinct_ids(s).select("i", "unique_id")


@query("select rec_idx, qname, mapq from reads qualify row_number() over (partition by qname order by mapq desc, rec_idx) = 1", "reads")
def dedup_best_mapq(spark, d):
    return merge.best_of_name(reads(spark, d)).select("rec_idx", "qname", "mapq")


# ---- comparing

_PAIRED = " union all ".join(f"select a.rec_idx, '{f}' as field, cast(a.{f} as varchar) as left_value, cast(b.{f} as varchar) as right_value from reads a join perturbed b on a.rec_idx = b.rec_idx where a.{f} is distinct from b.{f}" for f in diff.FIELDS)
_TAGDIFF = """select a.rec_idx, a.tag, s.side, a.value as left_value, '99' as right_value from tagrows a, (select unnest([1, 2]) as side) s where a.tag = 'AM' and a.rec_idx % 11 = 0 and a.value <> '99' and a.rec_idx <> (select max(rec_idx) from reads)"""


@query(_PAIRED, "perturbed")
def diff_rows(spark, d):
    return diff.rows(reads(spark, d), perturbed(spark, d))


@query(_TAGDIFF, "tagrows")
def diff_tags(spark, d):
    return diff.tags(reads(spark, d), perturbed(spark, d), ignore={"OQ"})


@query(f"select what, count(*) as n from (select field as what from ({_PAIRED}) x union all select 'tag:' || tag from ({_TAGDIFF}) y) z group by what", "perturbed", "tagrows")
def diff_summary(spark, d):
    a, b = reads(spark, d), perturbed(spark, d)
    return diff.summary(diff.rows(a, b), diff.tags(a, b))


@query(f"select count(*) as n from ({_PAIRED}) x", "perturbed")
def diff_total(spark, d):
    return diff.rows(reads(spark, d), perturbed(spark, d)).agg(F.count("*").alias("n"))


@query("""select a.rec_idx, 'tlen' as field, cast(a.mapq as varchar) as left_value, cast(b.mapq as varchar) as right_value from reads a join perturbed b on a.rec_idx = b.rec_idx where abs(a.mapq - b.mapq) > 2""", "perturbed")
def diff_tolerant(spark, d):
    a = reads(spark, d).withColumn("tlen", F.col("mapq"))
    b = perturbed(spark, d).withColumn("tlen", F.col("mapq"))
    return diff.rows(a, b, ignore={"mapq", "qual"}, flag_mask=1024, tlen_by=2)


@query(f"""select rec_idx, field from ({_PAIRED}) x where rec_idx <= (select max(rec_idx) from (select rec_idx from ({_PAIRED}) y order by rec_idx limit 20) z)""", "perturbed")
def diff_first(spark, d):
    return diff.first_differences(diff.rows(reads(spark, d), perturbed(spark, d)), 20).select("rec_idx", "field")


@query(f"""select x.rec_idx as counter, field, tag, premature, value1, value2, a.qname as name1, b.qname as name2 from (select rec_idx, field, null as tag, cast(0 as int) as premature, left_value as value1, right_value as value2 from ({_PAIRED}) p
    union all select rec_idx, 'TAG', tag, 0, left_value, right_value from ({_TAGDIFF}) t union all select max(rec_idx), null, null, 2, null, null from reads) x left join reads a on a.rec_idx = x.rec_idx left join perturbed b on b.rec_idx = x.rec_idx""", "perturbed", "tagrows")
def diff_table(spark, d):
    return diff.discrepancies(reads(spark, d), perturbed(spark, d)).drop("record1", "record2")


@query("""select cast(case when a.n < b.n then 1 when a.n > b.n then 2 else 0 end as int) as premature_end, abs(a.n - b.n) as missing from (select count(*) as n from reads) a, (select count(*) as n from perturbed) b""", "perturbed")
def premature_end(spark, d):
    return diff.premature_end(reads(spark, d), perturbed(spark, d))


@query("select rec_idx, case when rec_idx % 5 = 0 then '!NULL!' when length(qname) > 3 then left(qname, 3) || '...' else qname end as shown from reads", "reads")
def truncated_values(spark, d):
    return reads(spark, d).select("rec_idx", diff.truncated(F.expr("case when rec_idx % 5 <> 0 then qname end"), 3).alias("shown"))


@query("select rec_idx, 1 as read_pos, ascii(substring(qual, 1, 1)) - 33 as score_a, 40 as score_b from reads where rec_idx % 29 = 0 and (flag & 4) = 0 and substring(qual, 1, 1) <> 'I' and rec_idx <> (select max(rec_idx) from reads)", "reads")
def score_diff(spark, d):
    return lossy.score_differences(reads(spark, d), perturbed(spark, d).select("rec_idx", "cigar", "qual"), ref(spark, d)).select("rec_idx", "read_pos", "score_a", "score_b")


# ---- lossy scores

_BASES = """select a.rec_idx, a.read_pos, a.op, ascii(substring(r.qual, a.read_pos, 1)) - 33 as score, a.base, substring(f.seq, p.pos + p.r0 + (a.read_pos - p.q0) - 1, 1) as ref_base, r.mapq, r.flag, r.rname, p.pos, p.pos + p.r0 + (a.read_pos - p.q0) - 1 as at,
     (r.cigar = '10M2D22M' and a.read_pos in (11, 12)) as after_deletion
   from aligned a join reads r on r.rec_idx = a.rec_idx join placed p on p.rec_idx = a.rec_idx and a.read_pos > p.q0 and a.read_pos <= p.q0 + p.len and p.op = a.op join ref f on f.rname = r.rname where a.read_pos is not null"""
_ILLUMINA = "case when {s} >= 40 then 40 when {s} >= 35 then 37 when {s} >= 30 then 33 when {s} >= 25 then 27 when {s} >= 20 then 22 when {s} >= 10 then 15 when {s} >= 2 then 6 else {s} end"
_BIN = _ILLUMINA.format(s="score")


def _lossy_sql(value: str, extra: str = "", whole: str = "30") -> str:
    """value: SQL of the score of a base of a placed read, over the bases b; whole: of a score of an unplaced read."""
    return f"""with b as ({_BASES}), v as (select b.rec_idx, b.read_pos, {value} as q from b {extra})
      select rec_idx, string_agg(chr(cast(q as int) + 33), '' order by read_pos) as qual from v group by rec_idx
      union all select rec_idx, string_agg(chr(cast({whole} as int) + 33), '' order by i) from (select rec_idx, mapq, flag, i, ascii(substring(qual, i, 1)) - 33 as score from (select rec_idx, mapq, flag, qual, unnest(generate_series(1, length(qual))) as i from reads where (flag & 4) <> 0) x) u group by rec_idx"""


_VIEWS = ("aligned", "placed", "reads", "ref")
_COV = "left join (select rname as cr, ref_pos as cp, count(*) as coverage from aligned where ref_pos is not null group by 1, 2) c on c.cr = b.rname and c.cp = b.at"
_MIS = "left join (select rname as cr, ref_pos as cp, count(*) as mismatches from aligned where op = 'M' and base <> ref_base group by 1, 2) c on c.cr = b.rname and c.cp = b.pos + b.read_pos - 1"
_MODELS = {
    "lossy_N40_D8": ("N40-D8", f"case when base <> ref_base then score when after_deletion then {_BIN} else 30 end", "", "30"),
    "lossy_R8_N40": ("R8-N40", f"case when base <> ref_base then score else {_BIN} end", "", "30"),
    "lossy_m5": ("m5", "case when mapq < 5 then score else 30 end", "", "case when mapq < 5 then score else 30 end"),
    "lossy_M20_8": ("M20_8", f"case when mapq > 20 then {_BIN} else 30 end", "", f"case when mapq > 20 then {_BIN} else 30 end"),
    "lossy_star8": ("*8", _BIN, "", _BIN),
    "lossy_U": ("U40-I8", f"case when op = 'I' then {_BIN} else 30 end", "", "score"),
    "lossy_R40X10_N40": ("R40X10-N40", "case when base <> ref_base then score when op = 'M' and coalesce(coverage, 0) < 10 then score when op <> 'M' and base = ref_base then score else 30 end", _COV, "30"),
    "lossy_P": ("P1_40", "case when coalesce(mismatches, 0) > 1 then score else 30 end", _MIS, "30"),
}


def _model(name, spec):
    def run(spark, d):
        return lossy.apply(reads(spark, d), ref(spark, d), spec)

    run.__doc__ = f"Scores after the model {spec}."
    return run


for _name, (_spec, _value, _extra, _whole) in _MODELS.items():
    query(_lossy_sql(_value, _extra, _whole), *_VIEWS, name=_name)(_model(_name, _spec))


@query(f"""with b as ({_BASES}) select rec_idx, cast(sum(case when base <> ref_base or after_deletion then 1 else 0 end) as bigint) as kept, sum(case when base <> ref_base or after_deletion then 1 else 0 end) > count(*) // 2 as whole from b group by rec_idx""", *_VIEWS)
def lossy_stored_whole(spark, d):
    return lossy.stored_whole(reads(spark, d), ref(spark, d), "N40-D8")


@query(f"""with b as ({_BASES}), v as (select *, case when base <> ref_base then score else 30 end as score_b from b) select rec_idx, read_pos, true as obeys from v where score <> score_b""", *_VIEWS)
def score_obeys_model(spark, d):
    r, s = reads(spark, d), ref(spark, d)
    lost = r.select("rec_idx", "cigar").join(lossy.apply(r, s, "N40"), "rec_idx")
    return lossy.obeys(lossy.score_differences(r, lost, s), "N40").select("rec_idx", "read_pos", "obeys")
