"""Prefix-target expansion of conversations, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only the
characters of that reply lie under the loss mask. Turns after the last reply (or a conversation
without a reply) come out as one example without a mask, so that no turn is lost.

Template, a turn: `<turn role="ROLE">`, newline, TEXT, `</turn>`, newline. In ROLE and TEXT a
backslash is written `\\s`, `<` is written `\\l`, and in ROLE `"` is written `\\q`; no control string can
then occur inside a turn, and reading back is exact.

Defined results: a null role or text counts as empty; a null turn number sorts first; rows with
the same turn number are ordered by role and text, and repeated rows are repeated turns; null
conversation ids form one conversation; an empty table gives an empty result; other columns are
ignored. An example holds its whole context by definition, so one conversation must fit a task;
conversations are never split or cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAD, MID, TAIL = '<turn role="', '">\n', "</turn>\n"


def _lit_replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    """Text without `<`, and with backslashes only as the first character of an escape."""
    return _lit_replace(_lit_replace(c, "\\", "\\s"), "<", "\\l")


def unescape(c: Column) -> Column:
    """The inverse of escape(), and of the role's extra escape."""
    return _lit_replace(_lit_replace(_lit_replace(c, "\\q", '"'), "\\l", "<"), "\\s", "\\")


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row for each example: conv, example (position of the reply, or of the last turn where nothing is trainable), formatted, loss_start and loss_end (code points, end exclusive; null: no mask)."""
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    head = F.concat(F.lit(HEAD), _lit_replace(escape(F.col("role")), '"', "\\q"), F.lit(MID))
    rows = rows.select(
        "conv", "role", F.row_number().over(order).alias("pos"), head.alias("head"), escape(F.col("text")).alias("body"),
        F.sum(F.length(head) + F.length(escape(F.col("text"))) + len(TAIL)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"),
    )
    item = F.struct(
        "pos", F.concat("head", "body", F.lit(TAIL)).alias("part"), "stop", (F.col("role") == target).alias("trainable"),
        (F.col("stop") - len(TAIL) - F.length("body")).alias("start"),
    )
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(item)).alias("items"))
    last = F.slice("items", -1, 1)
    chosen = F.concat(F.filter("items", lambda x: x["trainable"]), F.filter(last, lambda x: ~x["trainable"]))
    whole = whole.select("conv", F.array_join(F.transform("items", lambda x: x["part"]), "").alias("whole"), F.explode(F.transform(chosen, lambda x: x.dropFields("part"))).alias("e"))
    return whole.select(
        F.col("conv").alias(conv), F.col("e.pos").alias("example"), F.expr("substring(whole, 1, cast(e.stop as int))").alias("formatted"),
        F.when(F.col("e.trainable"), F.col("e.start")).alias("loss_start"),
        F.when(F.col("e.trainable"), F.col("e.stop") - len(TAIL)).alias("loss_end"),
    )


def read_back(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what the examples say, one row for each conversation, parsed from their formatted texts and masks alone."""
    said = F.when(F.col("loss_start").isNotNull(), F.struct("example", F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))").alias("said")))
    per = examples.groupBy(conv).agg(
        F.max_by("formatted", "example").alias("longest"), F.array_sort(F.collect_list(said)).alias("said"), F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    parts = F.filter(F.split("longest", TAIL), lambda x: x != "")
    shape = r'(?s)^<turn role="([^"]*)">\n(.*)$'
    per = per.select(
        conv, "formatted_chars",
        F.transform(parts, lambda x: F.concat(unescape(F.regexp_extract(x, shape, 1)), F.lit("\n"), unescape(F.regexp_extract(x, shape, 2)), F.lit("\n"))).alias("turns"),
        F.array_join(F.transform("said", lambda x: unescape(x["said"])), "").alias("loss"),
    )
    return per.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"),
    )


def op4_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the control-string conversation -7, expanded and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"),
    )
    return read_back(expand(turns.unionByName(extra)))


SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p as (
  select *, row_number() over w as pos,
    23 + length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '"', '\q')) + length(replace(replace(text, '\', '\s'), '<', '\l')) as len,
    count(*) over (partition by conv_id) as n
  from t window w as (partition by conv_id order by turn nulls first, role, text)),
c as (select *, sum(len) over (partition by conv_id order by pos) as stop from p)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by pos), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' or pos = n then stop else 0 end) as bigint) as formatted_chars
from c group by conv_id
"""
