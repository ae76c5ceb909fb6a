"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Words are summed by source and hash bucket; within each source the bucket in which the running sum
crosses the budget is found, and only that boundary bucket is split again by further bits of the
hash, level by level, until the threshold is exact. Documents are then filtered by comparing their
hash with their source's threshold: nothing is sorted, and the only shuffles carry sums. Where the
boundary is a text that occurs several times, as many of its rows are taken as come nearest to the budget: rows are numbered by
their place in the table, by counts for each partition and then within the one partition where the number is reached.

Defined results: a null text has size 0; null sources form one source, ordered last; the hash
covers id and text, so reruns agree; of repeated rows some may come once more than others, which of them makes no
difference to what is taken; sources of size 0 have target 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import WORD, cut, documents, text_or_empty
from readloom.operators.cuts import numbered, running

#: Bits of the hash, and how many of them each level of histograms splits.
LEVELS = (12, 12, 12, 12)
BITS = sum(LEVELS)
#: Up to so many sources (a row of a few numbers each) the table of thresholds is broadcast.
BROADCAST_SOURCES = 50_000


def _key() -> Column:
    said = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text_or_empty())
    return F.conv(F.substring(F.md5(said), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size -> target too: weights repeat over the sources by code point, a target stops at cap times its source's size and the excess goes to the others by weight.

    Resharing ends at one level L with target = min(cap * size, L * weight); sources are put in
    order of cap * size / weight, and L is the first quotient (budget left) / (weight left) that its
    own source can take. Sources are ordered and summed by ranges, as there may be many; the driver gets three sums.
    """
    by_name = numbered(sizes, [F.col("source").asc_nulls_last()], "nth")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("double")
    s = by_name.select("source", "source_size", weight.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    s = running(s, [(F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], {"upto_most": F.col("most"), "upto_weight": F.col("weight")})
    total, weighed = s.agg(F.sum("source_size"), F.sum("weight")).collect()[0]
    if total is None:
        return s.select("source", "source_size", F.lit(0.0).alias("target"))
    level = (F.lit(float(share) * total) - (F.col("upto_most") - F.col("most"))) / (F.lit(weighed) - (F.col("upto_weight") - F.col("weight")))
    top = s.withColumn("level", level).where(F.col("level") <= F.col("most") / F.col("weight")).agg(F.max("level")).collect()[0][0]
    target = F.col("most") if top is None else F.least("most", F.lit(top) * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def _same(a: DataFrame, b: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Join on the source, nulls alike; b has one row for each source."""
    b = b.withColumnRenamed("source", "b_source")
    return a.join(F.broadcast(b) if small else b, a["source"].eqNullSafe(b["b_source"]), how).drop("b_source")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), _key().alias("key"), F.monotonically_increasing_id().alias("row"))


def limits(slim: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, bool]:
    """source, source_size, target, base, limit, last: a document comes `base` times, and once more if its key is below `limit`, or is `limit` and its row is `last` at most; and whether the table is small enough to broadcast. slim: source, size, key, row (numbers that rise with the table's partitions)."""
    src = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    fits = F.col("source_size") > 0
    src = src.withColumn("base", F.when(fits, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    # budget: words still to take beyond whole passes; prefix: the hash bits of the boundary so far; under: words below it
    src = cut(src.withColumns({"budget": F.col("target") - F.col("base") * F.col("source_size"), "prefix": F.lit(0).cast("long"), "under": F.lit(0).cast("long")}))
    small = src.count() <= BROADCAST_SOURCES
    used = 0
    for bits in LEVELS:
        used += bits
        inside = _same(slim, src.select("source", "prefix"), small)
        inside = inside.where(F.shiftright("key", BITS - used + bits) == F.col("prefix"))
        hist = inside.groupBy("source", F.shiftright("key", BITS - used).alias("bucket")).agg(F.sum("size").alias("words"))
        hist = _same(hist, src.select("source", "budget", "under"), small)
        upto = F.col("under") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("upto", upto)
        # the first bucket whose running sum passes the budget; its words are the last level's tie
        edge = hist.where(F.col("upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "words")).alias("edge"))
        src = _same(src, edge, small, "left").select(
            "source", "source_size", "target", "base", "budget",
            F.coalesce("edge.bucket", F.shiftleft(F.col("prefix") + 1, bits)).alias("prefix"),
            F.coalesce(F.col("edge.upto") - F.col("edge.words"), "under").alias("under"),
            F.coalesce("edge.upto", "under").alias("upto"),
        )
        src = cut(src)
    # the boundary is one key; of its rows, which have one text, so many go in as come nearest to the budget
    src = src.select("source", "source_size", "target", "base", F.when(F.col("budget") <= 0, 0).otherwise(F.col("prefix")).alias("limit"), F.when(F.col("budget") <= 0, 0).otherwise(F.col("budget") - F.col("under")).alias("over"))
    part = F.shiftright("row", 33)
    at = _same(slim, src.select("source", "limit", "over"), small).where(F.col("key") == F.col("limit"))
    per = at.groupBy("source", part.alias("part")).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.max("over").alias("over"))
    every = Window.partitionBy("source")
    per = per.withColumns({"upto": F.sum("n").over(every.orderBy("part")), "mean": F.sum("words").over(every) / F.sum("n").over(every)})
    per = per.withColumn("take", F.least(F.ceil(F.col("over") / F.col("mean") - 0.5), F.sum("n").over(every))).where("mean > 0 and take > 0")
    # the partition in which the last row taken lies (one for each source), and the row in it
    edge = per.where("upto >= take").groupBy("source").agg(F.min(F.struct("part", (F.col("take") - (F.col("upto") - F.col("n"))).alias("nth"))).alias("edge"))
    edge = cut(edge.select("source", "edge.part", "edge.nth"))
    inside = _same(at.select("source", "row", part.alias("own")), edge, small).where(F.col("own") == F.col("part"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("row"))
    last = inside.withColumn("i", nth).where(F.col("i") == F.col("nth")).select("source", F.col("row").alias("last"))
    src = _same(src.drop("over"), last, small, "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    return cut(src), small


def copies() -> Column:
    return F.col("base") + ((F.col("key") < F.col("limit")) | ((F.col("key") == F.col("limit")) & (F.col("row") <= F.col("last")))).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, copies (how often the mix takes the document)."""
    slim = cut(_slim(docs))
    out = _same(slim, *limits(slim, **options))
    return out.select("doc_id", "size", "source_size", "target", copies().alias("copies"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, with the columns of docs; a document taken twice comes twice. Texts aren't shuffled: each row meets its source's threshold.

    docs is read twice and should give its rows in the same partitions both times, as a table of files does; else of the boundary's
    repeated rows not exactly so many are taken as were meant.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "source", _key().alias("key"), F.monotonically_increasing_id().alias("row"))
    out = _same(rows, *limits(cut(_slim(docs)), **options)).select("doc", copies().alias("copies")).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and words taken of every document."""
    out = mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':' || coalesce(text, '')), 1, 12) as bigint) as key
  from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, cast([3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as double) as weight, 2.0::double * source_size as most from s0),
s2 as (select *, (1.5::double * (select sum(source_size) from s1)
    - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as level from s1),
s3 as (select *, (select max(level) from s2 where level <= most / weight) as l from s2),
s4 as (select source, source_size, coalesce(least(most, l * weight), most) as target from s3),
s as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as base from s4),
k as (select source, key, sum(size) as words, count(*) as n from d group by source, key),
c as (select *, sum(words) over (partition by source order by key) as upto from k),
x as (select c.source, c.key, s.base, case
    when s.target - s.base * s.source_size <= 0 then 0
    when c.upto <= s.target - s.base * s.source_size then c.n
    when c.upto - c.words <= s.target - s.base * s.source_size
     then least(c.n, ceil((s.target - s.base * s.source_size - (c.upto - c.words)) / (c.words / c.n) - 0.5))
    else 0 end as more
  from c join s on c.source is not distinct from s.source),
r as (select *, row_number() over (partition by source, key) as i from d)
select d.doc_id, d.size, s.source_size, s.target, cast(d.size * (x.base + case when d.i <= x.more then 1 else 0 end) as bigint) as taken
from r d join s on d.source is not distinct from s.source join x on d.source is not distinct from x.source and d.key = x.key
"""
