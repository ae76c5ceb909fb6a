"""Sequencing tables derived from the driver's tables, the same in Spark and in SQL.

Contigs are cut from long documents; there is one read of 32 bases for each order, two to a template,
with five CIGAR shapes and a planted mismatch in the `32M` reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import cigar

AZ, NT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"
#: What upper case is taken from one character at a time, as SQL does: Spark's upper() makes two letters of one (of a sharp s, of ligatures). The last two are the only characters beyond a-z that have one of A-Z as their upper case.
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz\u0131\u017f", "ABCDEFGHIJKLMNOPQRSTUVWXYZIS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a table in one small file would leave all later work to one task. Tables in many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, rname, seq: five contigs, the letters of whole documents."""
    d = table(spark, sf_dir, "documents")
    chosen = d.where("n_chars >= 3000").groupBy((F.col("doc_id") % 5).alias("ref_id")).agg(F.min("doc_id").alias("doc_id"))
    letters = F.translate(F.regexp_replace(F.translate("text", LOWER, UPPER), "[^A-Z]", ""), AZ, NT)
    # five rows at most; without the hint every text is shuffled to meet them
    return d.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("ref_id", F.concat(F.lit("chr"), (F.col("ref_id") + 1).cast("string")).alias("rname"), letters.alias("seq"))


_BITS = """cast(1 + 2*(case when t%3=0 then 1 else 0 end) + 4*unm + 16*(k%2) + 64*(1-k%2) + 128*(k%2)
       + 256*(case when k%31=0 then 1 else 0 end) + 1024*(case when k%17=0 then 1 else 0 end) as int)"""
_SEQ = """case k%5 when 0 then concat(substring(seq,pos,15),'N',substring(seq,pos+16,16))
           when 1 then concat(substring(seq,pos,10),substring(seq,pos+12,22))
           when 2 then concat('TTTTT',substring(seq,pos,27))
           when 3 then concat(substring(seq,pos,12),'GGG',substring(seq,pos+12,17))
           else concat(substring(seq,pos,16),substring(seq,pos+21,16)) end"""
_STEP = 64
_PIECE_SEQ = _SEQ.replace("seq,pos", f"piece,(pos-1)%{_STEP}+1")
_SHAPE = "case k % 5 when 0 then '32M' when 1 then '10M2D22M' when 2 then '5S27M' when 3 then '12M3I17M' else '16M5N16M' end"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records: qname, flag, rname, pos, mapq, cigar, seq, qual, tags, aln_end, rec_idx."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    o = o.selectExpr("o_orderkey as k", "cast(floor(o_orderkey / 2) as bigint) as t", "cast(round(o_totalprice * 100) as bigint) as cents", "md5(cast(o_orderkey as string)) as h")
    # five contigs, each the letters of one document, are met with the orders where these are read; a letter of a long text is found by
    # walking to it, so contigs come as pieces of 128 letters, one for each 64, and a read looks into one piece
    pieces = F.regexp_extract_all("seq", F.lit(f"(?=(.{{1,{2 * _STEP}}})).{{1,{_STEP}}}"), F.lit(1))
    contigs = ref(spark, sf_dir).select("ref_id", "rname", F.length("seq").alias("letters"), pieces.alias("pieces"))
    p = o.join(F.broadcast(contigs), F.col("ref_id") == F.col("t") % 5).selectExpr("*", "cast(1 + (cents % (letters - 80)) as int) as pos", "case when k % 23 = 0 then 1 else 0 end as unm", f"{_SHAPE} as cig")
    p = p.selectExpr("k", "t", "cents", "h", "rname", "pos", "unm", "cig", f"coalesce(try_element_at(pieces, cast(floor((pos - 1) / {_STEP}) + 1 as int)), '') as piece")
    out = p.selectExpr(
        "concat('t', cast(t as string)) as qname", f"{_BITS} as flag", "case when unm=1 then '*' else rname end as rname", "case when unm=1 then 0 else pos end as pos",
        "case when unm=1 then 0 else cast(cents % 61 as int) end as mapq", "case when unm=1 then '*' else cig end as cigar", f"{_PIECE_SEQ} as seq", "translate(h,'0123456789abcdef','!#(+05:?@ABCDEFI') as qual",
        """map_filter(map('RG', struct('Z' as type, concat('rg', cast(k % 3 as string)) as value), 'AM', struct('c' as type, cast(k % 40 as string) as value),
             'OQ', struct('Z' as type, reverse(translate(h,'0123456789abcdef','!#(+05:?@ABCDEFI')) as value), 'XA', struct('Z' as type, case when k % 7 = 0 then concat('x', cast(k % 100 as string)) end as value)), (n, v) -> v.value is not null) as tags""",
        "k as rec_idx",
    )
    return out.withColumn("aln_end", F.when(F.col("flag").bitwiseAND(4) != 0, 0).otherwise(cigar.alignment_end(F.col("pos"), F.col("cigar"))))


def split_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads, and a supplementary record three letters on for each tenth of those that are placed."""
    r = reads(spark, sf_dir).withColumn("k", F.explode(F.expr("case when rec_idx % 10 = 3 and flag & 4 = 0 then array(0, 1) else array(0) end")))
    return r.withColumns({
        "flag": F.expr("cast(flag | (2048 * k) as int)"), "pos": F.expr("pos + 3 * k"), "aln_end": F.expr("aln_end + 3 * k"), "rec_idx": F.expr("rec_idx + 10000000000 * k"),
    }).drop("k")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.operators.pileup import aligned_bases

    return aligned_bases(reads(spark, sf_dir).where("flag & 4 = 0"), ref(spark, sf_dir))


def perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version of the reads: some flags, insert sizes' neighbours (mapq), tags and scores differ, and the last record is missing."""
    r = reads(spark, sf_dir)
    last = r.agg(F.max("rec_idx").alias("last"))
    r = r.join(F.broadcast(last), F.col("rec_idx") != F.col("last"), "left_semi")  # one row
    tag = F.expr("transform_values(tags, (n, v) -> struct(v.type as type, case when n = 'AM' and rec_idx % 11 = 0 then '99' else v.value end as value))")
    return r.withColumns({
        "flag": F.expr("case when rec_idx % 13 = 0 then flag ^ 1024 else flag end"), "mapq": F.expr("case when rec_idx % 19 = 0 then mapq + rec_idx % 4 else mapq end").cast("int"),
        "tags": tag,
        "qual": F.expr("case when rec_idx % 29 = 0 then concat('I', substring(qual, 2, 100)) else qual end"),
    })


#: The same views in DuckDB SQL; each may use those before it.
VIEWS = {
    "ref": f"""select c.ref_id, c.rname, translate(regexp_replace(upper(d.text), '[^A-Z]', '', 'g'), '{AZ}', '{NT}') as seq
       from (select doc_id % 5 as ref_id, concat('chr', cast(doc_id % 5 + 1 as varchar)) as rname, min(doc_id) as doc_id from documents where n_chars >= 3000 group by 1, 2) c
       join documents d on c.doc_id = d.doc_id""",
    "reads0": f"""select concat('t', cast(t as varchar)) as qname, {_BITS} as flag, case when unm=1 then '*' else rname end as rname, case when unm=1 then 0 else pos end as pos,
         case when unm=1 then 0 else cast(cents % 61 as int) end as mapq, case when unm=1 then '*' else cig end as cigar, {_SEQ} as seq,
         translate(h,'0123456789abcdef','!#(+05:?@ABCDEFI') as qual, k as rec_idx
       from (select *, cast(1 + (cents % (length(seq) - 80)) as int) as pos, case when k % 23 = 0 then 1 else 0 end as unm, {_SHAPE} as cig
         from (select o_orderkey as k, cast(floor(o_orderkey / 2) as bigint) as t, cast(round(o_totalprice * 100) as bigint) as cents, md5(cast(o_orderkey as varchar)) as h from orders) o
         join ref on ref_id = t % 5) p""",
    "reads": """select *, case when (flag & 4) <> 0 then 0 else cast(pos - 1 + coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: cast(x as int))), 0) as int) end as aln_end from reads0""",
    "split_reads": """select * from reads union all select * replace (flag | 2048 as flag, pos + 3 as pos, aln_end + 3 as aln_end, rec_idx + 10000000000 as rec_idx) from reads where rec_idx % 10 = 3 and (flag & 4) = 0""",
    "tagrows": """select rec_idx, 'RG' as tag, 'Z' as type, concat('rg', cast(rec_idx % 3 as varchar)) as value from reads union all
       select rec_idx, 'AM', 'c', cast(rec_idx % 40 as varchar) from reads union all
       select rec_idx, 'OQ', 'Z', reverse(qual) from reads union all
       select rec_idx, 'XA', 'Z', concat('x', cast(rec_idx % 100 as varchar)) from reads where rec_idx % 7 = 0""",
    "ops": """select rec_idx, qname, flag, rname, pos, seq, qual, mapq, cast(i as int) as idx, cast(regexp_extract(els[i], '([0-9]+)', 1) as int) as len, right(els[i], 1) as op
       from (select *, unnest(generate_series(1, len(els))) as i from (select *, regexp_extract_all(cigar, '([0-9]+[MIDNSHP=X])', 1) as els from reads where (flag & 4) = 0) a) b""",
    "placed": """select *, cast(coalesce(sum(case when op in ('M','I','S','=','X') then len else 0 end) over w, 0) as int) as q0, cast(coalesce(sum(case when op in ('M','D','N','=','X') then len else 0 end) over w, 0) as int) as r0
       from ops window w as (partition by rec_idx order by idx rows between unbounded preceding and 1 preceding)""",
    "aligned": """select p.rec_idx, p.qname, p.flag, p.rname, p.op, case when op in ('M','I','S','=','X') then q0 + k end as read_pos,
         case when op in ('M','D','N','=','X') then pos + r0 + k - 1 end as ref_pos,
         case when op in ('M','I','S','=','X') then substring(p.seq, q0 + k, 1) end as base, case when op in ('M','D','N','=','X') then substring(r.seq, pos + r0 + k - 1, 1) end as ref_base
       from (select *, cast(unnest(generate_series(1, len)) as int) as k from placed) p join ref r on r.rname = p.rname""",
    "perturbed": """select qname, case when rec_idx % 13 = 0 then xor(flag, 1024) else flag end as flag, rname, pos, cast(case when rec_idx % 19 = 0 then mapq + rec_idx % 4 else mapq end as int) as mapq, cigar, seq,
         case when rec_idx % 29 = 0 then concat('I', substring(qual, 2, 100)) else qual end as qual, rec_idx, aln_end
       from reads where rec_idx <> (select max(rec_idx) from reads)""",
}
_USES = {"reads0": ("ref",), "reads": ("reads0",), "split_reads": ("reads",), "tagrows": ("reads",), "ops": ("reads",), "placed": ("ops",), "aligned": ("placed", "ref"), "perturbed": ("reads",)}


def sql(query: str, *views: str) -> str:
    """query with the views that it names put before it."""
    need: list[str] = []

    def add(v: str) -> None:
        for x in _USES.get(v, ()):
            add(x)
        if v not in need:
            need.append(v)

    for v in views:
        add(v)
    lead = ", ".join(f"{v} as ({VIEWS[v]})" for v in need)
    query = query.strip()
    if not lead:
        return query
    if query.lower().startswith("with recursive "):
        return f"with recursive {lead}, {query[15:]}"
    return f"with {lead}, {query[5:]}" if query.lower().startswith("with ") else f"with {lead} {query}"
