"""Queries on records: scans, filters, projections, sequences, scores, tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import cigar, flags, qual, seq, tags
from readloom.operators import filters, projections, stats
from readloom.operators.cuts import numbered
from readloom.plans.fixtures import reads, ref, table
from readloom.plans.registry import query
from readloom.schema import FLAGS

_COLS = "rec_idx, qname, flag, rname, pos, mapq, cigar, seq, qual"
_LIST = _COLS.split(", ")


def _plain(df):
    return df.select(*_LIST)


@query(f"select {_COLS}, aln_end from reads", "reads")
def scan_reads(spark, d):
    return reads(spark, d).select(*_LIST, "aln_end")


@query("select ref_id, rname, seq, cast(length(seq) as int) as length, md5(upper(seq)) as md5 from ref", "ref")
def scan_reference(spark, d):
    return ref(spark, d).select("ref_id", "rname", "seq", F.length("seq").alias("length"), F.md5(F.upper("seq")).alias("md5"))


@query(
    """select rname, count(*) as n_reads, cast(sum(length(seq)) as bigint) as n_bases, cast(sum(mapq) as bigint) as sum_mapq, max(aln_end) as max_end
       from reads where (flag & 2304) = 0 and pos <= 1500 and aln_end >= 100 group by 1""", "reads")
def flagstat_by_contig(spark, d):
    return stats.flagstat_by_contig(reads(spark, d))


@query(f"select {_COLS} from reads where (flag & 1040) <> 0", "reads")
def flag_required_any(spark, d):
    return _plain(filters.required_any(reads(spark, d), 1040))


@query(f"select {_COLS} from reads where (flag & 65) = 65", "reads")
def flag_required_all(spark, d):
    return _plain(filters.required_all(reads(spark, d), 65))


@query(f"select {_COLS} from reads where (flag & 2304) = 0", "reads")
def flag_excluded(spark, d):
    return _plain(filters.excluded(reads(spark, d), 2304))


@query("select rec_idx, " + ", ".join(f"(flag & {b}) <> 0 as is_{n}" for n, b in FLAGS.items()) + " from reads", "reads")
def flag_decode(spark, d):
    return reads(spark, d).select("rec_idx", *flags.decode(F.col("flag")))


@query(f"select {_COLS} from reads where rname = 'chr1' and pos <= 900 and greatest(pos, aln_end) >= 500", "reads")
def region_overlap(spark, d):
    return _plain(filters.in_region(reads(spark, d), "chr1:500-900"))


@query(f"select {_COLS} from reads where rname = 'chr1' and pos >= 500 and greatest(pos, aln_end) <= 900", "reads")
def region_contained(spark, d):
    return _plain(filters.in_region(reads(spark, d), "chr1:500-900", "contained"))


@query(f"select {_COLS} from reads where rname = 'chr2' and pos = (select max(pos) from reads where rname = 'chr2')", "reads")
def region_starting_at(spark, d):
    """Reads that start where the last ones of the contig do."""
    r = reads(spark, d)
    last = r.where("rname = 'chr2'").agg(F.max("pos")).collect()[0][0]
    return _plain(filters.in_region(r, f"chr2:{last}", "starting_at"))


@query(f"""select 0 as region, {_COLS} from reads where rname = 'chr1' and pos <= 400 and greatest(pos, aln_end) >= 100
    union all select 1, {_COLS} from reads where rname = 'chr1' and pos <= 700 and greatest(pos, aln_end) >= 300
    union all select 2, {_COLS} from reads where rname = 'chr3' and greatest(pos, aln_end) >= 1200""", "reads")
def region_multi(spark, d):
    return filters.in_regions(reads(spark, d), ["chr1:100-400", "chr1:300-700", "chr3:1200"]).select("region", *_LIST)


@query(f"select {_COLS} from reads where rname = '*'", "reads")
def unmapped_region(spark, d):
    return _plain(filters.in_region(reads(spark, d), "*"))


@query(f"select {_COLS} from reads where (flag & 4) <> 0", "reads")
def unmapped_only(spark, d):
    return _plain(filters.unmapped(reads(spark, d)))


@query(f"select {_COLS} from reads where (flag & 2304) = 0", "reads")
def primary_only(spark, d):
    return _plain(filters.primary(reads(spark, d)))


@query(f"select {_COLS} from reads where mapq < 20", "reads")
def mapq_lt(spark, d):
    return _plain(filters.mapq_below(reads(spark, d), 20))


@query(f"select {_COLS} from reads where mapq > 40", "reads")
def mapq_gt(spark, d):
    return _plain(filters.mapq_above(reads(spark, d), 40))


@query("""select rule, count(*) as n from (
      select case when (flag & 4) <> 0 and mapq <> 0 then 'mapq_of_unmapped' end as rule from reads
      union all select case when (flag & 4) <> 0 and cigar <> '*' then 'unmapped_with_cigar' end from reads
      union all select case when (flag & 4) = 0 and pos < 1 then 'mapped_without_position' end from reads
      union all select case when (flag & 64) <> 0 and (flag & 128) <> 0 then 'first_and_second' end from reads
      union all select case when length(seq) <> length(qual) then 'lengths_differ' end from reads
      union all select case when (flag & 1) = 0 and (flag & 234) <> 0 then 'pair_bits_without_pair' end from reads) x where rule is not null group by rule""", "reads")
def validation_summary(spark, d):
    return filters.validation_summary(reads(spark, d))


@query("""select rule, count(*) as n from (
      select case when (flag & 4) <> 0 and mapq <> 0 then 'mapq_of_unmapped' end as rule from reads
      union all select case when (flag & 4) <> 0 and cigar <> '*' then 'unmapped_with_cigar' end from reads
      union all select case when (flag & 4) = 0 and pos < 1 then 'mapped_without_position' end from reads
      union all select case when (flag & 64) <> 0 and (flag & 128) <> 0 then 'first_and_second' end from reads
      union all select case when length(seq) <> length(qual) then 'lengths_differ' end from reads
      union all select case when (flag & 1) = 0 and (flag & 234) <> 0 then 'pair_bits_without_pair' end from reads
      union all select case when rec_idx % 41 = 0 or length(seq) <> 32 then 'cigar_length_differs' end from reads where (flag & 4) = 0
      union all select case when rec_idx % 43 = 0 then 'unknown_contig' end from reads where (flag & 4) = 0
      union all select case when rec_idx % 43 <> 0 and rec_idx % 50 = 0 then 'beyond_contig' end from reads where (flag & 4) = 0
      union all select case when not ((a.flag & 1) <> 0 and (b.flag & 1) <> 0 and ((a.flag & 8) <> 0) = ((b.flag & 4) <> 0) and ((b.flag & 8) <> 0) = ((a.flag & 4) <> 0) and ((a.flag & 32) <> 0) = ((b.flag & 16) <> 0)
        and ((b.flag & 32) <> 0) = ((a.flag & 16) <> 0) and ((a.flag & 2) <> 0) = ((b.flag & 2) <> 0)) then 'mates_disagree' end from reads a join reads b on a.qname = b.qname and a.rec_idx <> b.rec_idx) x where rule is not null group by rule""", "reads")
def validation_with_reference(spark, d):
    """Planted: a CIGAR too long in every 41st record, a contig that isn't known in every 43rd, an end beyond the contig in every 50th."""
    r = reads(spark, d).withColumns({
        "cigar": F.expr("if(rec_idx % 41 = 0 and flag & 4 = 0, concat(cigar, '1M'), cigar)"), "rname": F.expr("if(rec_idx % 43 = 0 and flag & 4 = 0, 'chrUn', rname)"),
        "aln_end": F.expr("if(rec_idx % 50 = 0 and flag & 4 = 0, aln_end + 100000000, aln_end)"),
    })
    return filters.validation_with_reference(r, ref(spark, d))


@query("select rec_idx, cast(seq as varchar) as seq, rname from reads", "reads")
def select_fields(spark, d):
    return projections.select(reads(spark, d), "SEQ:RNAME")


@query("select rec_idx, qname, cast(flag as varchar) as flag, rname, cast(pos as varchar) as pos, cast(mapq as varchar) as mapq, cigar from reads", "reads")
def select_all_but(spark, d):
    return projections.select(reads(spark, d), "*SEQ:QUAL:RNEXT:PNEXT:TLEN/")


@query("select rec_idx, string_agg(tag || ':' || type || ':' || value, ' ' order by tag) as tags from tagrows where tag in ('RG', 'AM') group by rec_idx", "tagrows")
def select_tags(spark, d):
    return projections.select(reads(spark, d), "/RG:AM").select("rec_idx", tags.text(F.col("tags")).alias("tags"))


@query("select rec_idx, string_agg(tag || ':' || type || ':' || value, ' ' order by tag) as tags from tagrows where tag not in ('OQ', 'XA') group by rec_idx", "tagrows")
def tag_capture_ignore(spark, d):
    return reads(spark, d).select("rec_idx", tags.text(tags.kept(F.col("tags"), ignore=tags.names("OQ:XA"))).alias("tags"))


@query("""select t.rec_idx, r.qname || chr(9) || cast(r.pos as varchar) || chr(9) || string_agg(tag || ':' || type || value, chr(9) order by tag) as line
    from tagrows t join reads r on t.rec_idx = r.rec_idx where tag in ('AM', 'RG') group by t.rec_idx, r.qname, r.pos""", "tagrows")
def tabular_projection(spark, d):
    return projections.tabular(reads(spark, d), "QNAME:POS/RG:AM")


@query("select rec_idx, substring(seq, 1, 5) as seq, '[' || array_to_string(list_transform([pos, mapq], lambda x: cast(x as varchar)), ', ') || ']' as shown from reads", "reads")
def capped_and_printed(spark, d):
    return reads(spark, d).select("rec_idx", projections.capped(F.col("seq"), 5).alias("seq"), projections.text_of(F.array("pos", "mapq"), "array<int>").alias("shown"))


@query(f"select {_COLS}, cast(row_number() over (order by rec_idx) as int) as ordinal from reads qualify row_number() over (order by rec_idx) between 101 and 350", "reads")
def enumerate_skip_take(spark, d):
    return projections.skip_take(reads(spark, d), 100, 250).select(*_LIST, "ordinal")


@query("select rec_idx, concat(cast(rec_idx % 2 as varchar), '.', qname) as qname from reads", "reads")
def rename_prefix(spark, d):
    return projections.prefixed_names(reads(spark, d), F.col("rec_idx") % 2).select("rec_idx", "qname")


@query("""select r.rec_idx, concat('run7.', cast(n as varchar), ' ', r.qname) as new_name from reads r
    join (select qname, row_number() over (order by min(rec_idx)) as n from reads group by qname) t on t.qname = r.qname""", "reads")
def fastq_rename(spark, d):
    return projections.fastq_names(reads(spark, d), "run7").select("rec_idx", "new_name")


@query("""select rec_idx, coalesce(case when rec_idx % 4 < 2 then qname end, cast(min(rec_idx) over (partition by rec_idx // 2) as varchar)) as qname from reads""", "reads")
def generated_names(spark, d):
    lost = reads(spark, d).withColumn("qname", F.expr("case when rec_idx % 4 < 2 then qname end"))
    return projections.generated_names(lost, F.expr("rec_idx div 2")).select("rec_idx", "qname")


@query("select rec_idx, string_agg(tag || ':' || type || ':' || case when tag = 'RG' then 'new' else value end, ' ' order by tag) as tags from tagrows group by rec_idx", "tagrows")
def set_read_group(spark, d):
    return projections.with_read_group(reads(spark, d), "new").select("rec_idx", tags.text(F.col("tags")).alias("tags"))


@query("""select rec_idx, case when (flag & 1) = 0 then 0 when (flag & 64) <> 0 then 1 else 2 end as segment,
    case when (flag & 1) = 0 then 0 when (flag & 64) <> 0 then 1 when (flag & 128) <> 0 then 2 else 0 end as stream from reads""", "reads")
def segment_index(spark, d):
    return reads(spark, d).select("rec_idx", flags.segment(F.col("flag")).alias("segment"), flags.stream_index(F.col("flag")).alias("stream"))


@query("select count(*) as reads, cast(sum(length(seq)) as bigint) as bases from reads where (flag & 2304) = 0", "reads")
def count_reads_bases(spark, d):
    return stats.counts(filters.primary(reads(spark, d)))


@query("""select cast(q as int) as score, count(*) as n, case when q = 30 then '*' when q in (0,1,6,15,22,27,33,37,40) then '8' else '40' end as mark, chr(cast(q as int) + 33) as letter
    from (select ascii(substring(qual, i, 1)) - 33 as q from (select qual, unnest(generate_series(1, length(qual))) as i from reads) a) b group by q""", "reads")
def qstat(spark, d):
    return stats.quality_histogram(reads(spark, d))


@query("""select cast(q as int) as score, count(*) as n, case when q = 37 then '*' when q in (0,1,6,15,22,27,33,37,40) then '8' else '40' end as mark, chr(cast(q as int) + 33) as letter
    from (select ascii(substring(qual, i, 1)) - 33 as q from (select qual, unnest(generate_series(1, length(qual))) as i from reads where rec_idx % 10 <> 0) a) b group by q""", "reads")
def qstat_default_marked(spark, d):
    lost = reads(spark, d).withColumn("qual", F.expr("case when rec_idx % 10 = 0 then '*' else qual end"))
    return stats.quality_histogram(lost, default=37)


def _sql_bin(rule):
    a, b = "".join(chr(q + 33) for q in range(94)), "".join(chr(rule(q) + 33) for q in range(94))
    return f"select rec_idx, translate(qual, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}') as qual from reads"


@query(_sql_bin(qual.illumina_bin), "reads")
def bin_illumina(spark, d):
    return reads(spark, d).select("rec_idx", qual.binned(F.col("qual")).alias("qual"))


@query(_sql_bin(qual.ncbi_bin), "reads")
def bin_ncbi(spark, d):
    return reads(spark, d).select("rec_idx", qual.binned(F.col("qual"), qual.ncbi_bin).alias("qual"))


@query("select rec_idx, array_to_string(list_transform(generate_series(1, length(qual)), lambda i: cast(ascii(substring(qual, i, 1)) - 33 as varchar)), ',') as scores, qual as back from reads", "reads")
def phred_round_trip(spark, d):
    s = qual.to_scores(F.col("qual"))
    return reads(spark, d).select("rec_idx", F.array_join(s.cast("array<string>"), ",").alias("scores"), qual.from_scores(s).alias("back"))


@query("select rec_idx, case when (flag & 16) <> 0 then reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) else seq end as seq, case when (flag & 16) <> 0 then reverse(qual) else qual end as qual from reads where (flag & 2304) = 0", "reads")
def revcomp_fastq(spark, d):
    from readloom.operators.fastq import as_sequenced

    return as_sequenced(filters.primary(reads(spark, d))).select("rec_idx", "seq", "qual")


@query("""select rec_idx, case when (flag & 64) <> 0 then 1 else 2 end as segment,
    concat('@', qname, '/', case when (flag & 64) <> 0 then '1' else '2' end, chr(10), seq, chr(10), '+', chr(10), qual, chr(10)) as record from reads where (flag & 2304) = 0""", "reads")
def fastq_segments(spark, d):
    from readloom.operators.fastq import fastq_records

    return fastq_records(reads(spark, d)).select("rec_idx", "segment", "record")


@query("select rec_idx, concat('>', qname, '/', case when (flag & 64) <> 0 then '1' else '2' end, chr(10), seq, chr(10)) as record from reads where (flag & 2304) = 0", "reads")
def fasta_dump(spark, d):
    from readloom.operators.fastq import fasta_records

    return fasta_records(reads(spark, d)).select("rec_idx", "record")


@query("""select concat('t', cast(rec_idx // 2 as varchar)) as name, seq, qual, cast(77 + 64 * (rec_idx % 2) as int) as flag
    from reads where (flag & 2304) = 0""", "reads")
def fastq_to_records(spark, d):
    from readloom.operators.fastq import parse_records, to_unmapped

    lines = spark_lines(spark, d)
    return to_unmapped(parse_records(lines)).select(F.col("qname").alias("name"), "seq", "qual", "flag")


def spark_lines(spark, d):
    """The FASTQ text of primary reads, one record a row, as text."""
    from readloom.operators.fastq import fastq_records

    return fastq_records(reads(spark, d)).select("record")


@query("select doc_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') as bases from documents")
def normalize_bases(spark, d):
    return table(spark, d, "documents").select("doc_id", seq.normalize(F.col("text")).alias("bases"))


@query("select p_partkey, regexp_matches(upper(substring(p_type, 1, 3)), '^[ACGTURYSWKMBDHVN.-]*$') as valid from part")
def valid_sequence(spark, d):
    return table(spark, d, "part").select("p_partkey", seq.is_valid(F.col("p_type"), 3).alias("valid"))


@query("select rec_idx, reverse(seq) as turned, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) as rc, upper(seq) as up, array_to_string([qname, rname, cigar], '|') as joined from reads", "reads")
def sequence_functions(spark, d):
    r = reads(spark, d)
    return r.select("rec_idx", F.reverse("seq").alias("turned"), seq.reverse_complement(F.col("seq")).alias("rc"), F.upper("seq").alias("up"), F.concat_ws("|", "qname", "rname", "cigar").alias("joined"))


@query("""select rec_idx, translate(seq || case when length(seq) % 2 = 1 then '=' else '' end, '=ACMGRSVTWYHKDBN', '0123456789ABCDEF') as packed, seq as back from reads""", "reads")
def nybble_bases(spark, d):
    r = reads(spark, d)
    p = seq.nybbles(F.col("seq"))
    return r.select("rec_idx", F.hex(p).alias("packed"), seq.from_nybbles(p, F.length("seq")).alias("back"))


@query("""select rname, concat('/cache/', substring(m, 1, 2), '/', substring(m, 3, 2), '/', substring(m, 5)) as path, m as md5, rname as name, concat('http://host/', m) as uri, regexp_extract(concat('http://host/', m), '([^/]+)$', 1) as file
    from (select rname, md5(upper(seq)) as m from ref) x""", "ref")
def insert_path_pattern(spark, d):
    m = F.md5(F.upper("seq"))
    r = ref(spark, d).select("rname", m.alias("m"))
    both = seq.seq_id(F.concat("rname", "m"))
    uri = F.format_string("http://host/%s", F.col("m"))
    return r.select("rname", seq.path_of("/cache/%2s/%2s/%s", F.col("m")).alias("path"), both["md5"].alias("md5"), both["name"].alias("name"), uri.alias("uri"), seq.file_name(uri).alias("file"))


@query("""select p_partkey, p_size as major, cast(p_partkey % 7 as int) as minor, cast(case when p_partkey % 3 > 0 then p_partkey else 0 end as int) as build from part""")
def version_parse(spark, d):
    text = F.expr("concat(p_size, '.', p_partkey % 7, case when p_partkey % 3 > 0 then concat('-b', p_partkey) else '' end)")
    v = seq.version_parts(text)
    return table(spark, d, "part").select("p_partkey", v[0].alias("major"), v[1].alias("minor"), F.coalesce(F.try_element_at(v, F.lit(4)), F.lit(0)).alias("build"))


@query("select event_id, strftime(ts, '%Y-%m-%d') as day from events")
def date_reformat(spark, d):
    shown = F.date_format(F.col("ts"), "yyyy-MMM-dd hh:mm:ss.S")
    return table(spark, d, "events").select("event_id", seq.reformat_date(shown).alias("day"))


@query("""select qname, cast(row_number() over (order by length(qname), reverse(qname)) as int) as place from (select distinct qname from reads) x""", "reads")
def name_order(spark, d):
    names = reads(spark, d).select("qname").distinct()
    return numbered(names, list(seq.name_order(F.col("qname")))).select("qname", F.col("place").cast("int"))


@query("select rec_idx, cast(idx as int) as idx, len, op from (select rec_idx, idx, len, op from ops) x", "ops")
def cigar_ops(spark, d):
    from readloom.operators.pileup import cigar_elements

    return cigar_elements(reads(spark, d).where("flag & 4 = 0")).select("rec_idx", "idx", "len", "op")


@query("""select rec_idx, aln_end, case when len(codes) = 0 then '*' else cigar end as back, array_to_string(codes, ',') as codes from (
      select rec_idx, aln_end, cigar, list_transform(regexp_extract_all(cigar, '([0-9]+[MIDNSHP=X])', 1), lambda e: cast(cast(regexp_extract(e, '([0-9]+)', 1) as int) * 16 + instr('MIDNSHP=X', right(e, 1)) - 1 as varchar)) as codes from reads) x""", "reads")
def aln_end(spark, d):
    ops = cigar.parse(F.col("cigar"))
    return reads(spark, d).select("rec_idx", "aln_end", cigar.render(ops).alias("back"), F.array_join(cigar.encode(ops).cast("array<string>"), ",").alias("codes"))


@query("""select v, case when v between -128 and 127 then 'c' when v between 0 and 255 then 'C' when v between -32768 and 32767 then 's' when v between 0 and 65535 then 'S'
    when v between -2147483648 and 2147483647 then 'i' else 'I' end as type from (select distinct cast((o_orderkey % 7 - 1) * o_orderkey * 37 as bigint) as v from orders) x""")
def tag_types(spark, d):
    v = table(spark, d, "orders").selectExpr("(o_orderkey % 7 - 1) * o_orderkey * 37 as v").distinct()
    return v.select("v", tags.integer_type(F.col("v")).alias("type"))


@query("select rec_idx, cast(sum(case type when 'Z' then length(value) when 'c' then 1 end) as bigint) as bytes from tagrows group by rec_idx", "tagrows")
def tag_sizes(spark, d):
    sizes = F.aggregate(F.map_values("tags"), F.lit(0).cast("long"), lambda a, v: a + tags.byte_size(v["type"], v["value"]).cast("long"))
    return reads(spark, d).select("rec_idx", sizes.alias("bytes"))


@query("""select a.rec_idx, (x.value is not distinct from y.value) as same_xa from reads a
    join reads b on b.rec_idx = a.rec_idx + 7 left join tagrows x on x.rec_idx = a.rec_idx and x.tag = 'XA' left join tagrows y on y.rec_idx = b.rec_idx and y.tag = 'XA'""", "tagrows")
def tag_equality(spark, d):
    r = reads(spark, d).select("rec_idx", tags.get(F.col("tags"), "XA").alias("xa"))
    other = r.select((F.col("rec_idx") - 7).alias("rec_idx"), F.col("xa").alias("xb"))
    return r.join(other, "rec_idx").select("rec_idx", F.col("xa").eqNullSafe(F.col("xb")).alias("same_xa"))


@query("""select rec_idx, 'qname' as field, qname as value from reads union all select rec_idx, 'flag', cast(flag as varchar) from reads union all select rec_idx, 'rname', rname from reads
    union all select rec_idx, 'pos', cast(pos as varchar) from reads union all select rec_idx, 'mapq', cast(mapq as varchar) from reads union all select rec_idx, 'cigar', cigar from reads
    union all select rec_idx, 'seq', seq from reads union all select rec_idx, 'qual', qual from reads union all select rec_idx, concat('tag_', tag), value from tagrows""", "tagrows")
def decompose_unpivot(spark, d):
    return stats.decompose(reads(spark, d))


@query("""with f as (select 'qname' as field, qname as value from reads union all select 'flag', cast(flag as varchar) from reads union all select 'rname', rname from reads
    union all select 'pos', cast(pos as varchar) from reads union all select 'mapq', cast(mapq as varchar) from reads union all select 'cigar', cigar from reads
    union all select 'seq', seq from reads union all select 'qual', qual from reads union all select concat('tag_', tag), value from tagrows)
    select field, cast(sum(length(value)) as bigint) as bytes, cast(sum(length(value)) * 8 as double) / (select sum(length(seq)) from reads) as bits from f group by field""", "tagrows")
def bits_per_base(spark, d):
    return stats.bits_per_base(stats.decompose(reads(spark, d)))


@query("""select ref_id, rname from ref where regexp_matches(rname, '\\bchr.*\\b') order by starts_with(rname, 'chr') desc, ref_id limit 1""", "ref")
def name_lookup(spark, d):
    return filters.name_lookup(ref(spark, d).select("ref_id", "rname"), "chr")
