"""Repair of conversation structure by a dynamic program over the retained subsequence of turns.

A conversation should read `(s?(ua)+)?` by the initials of its roles. Its turns are kept (K), rerolled (R,
to user or assistant), deleted (D), and empty turns are inserted (I). The program walks over the
turns that may be retained; for a retained turn with an output role the best turn before it is found among
the running minima of four states (nothing yet, system, user, assistant), each held less the deletions up to it
(prefix sums), so the gap between two retained turns costs a subtraction; the pair of roles
tells the inserts between them. The last role tells the inserts at the end.

Ties go to the ASCII-least audit. Two audits that have passed the same turns and end in a turn's edit never are
prefixes of one another, so what decided between them decides for ever: the order of the four states'
audits is all that is carried, not the audits. A turn costs constant time, and one small integer stays for each state.

A conversation is one chain, and its digest runs over all its texts in order, so one task walks it; but rows pass it in
sorted order, one after another: it holds edits (some bytes a turn), never texts. Equal turns are counted before
they are shuffled, and repeats are found by (conversation, digest), not by conversation.

Defined results: nulls in role or text count as one space; null turn numbers come first, rows of one turn number in order of
role, then of a digest of role and text; repeated rows are repeated turns, all but the first are duplicates; null conversation ids form one
conversation; an empty role has the initial ' ' (it can't be kept); a very long text is read where it lies; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import crc_sql, freed

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing put out yet, or the last role put out. Inserts between a state and a retained role, and at the end.
NONE, SYSTEM, USER, ASSISTANT = range(4)
GAP = {(NONE, SYSTEM): 0, (NONE, USER): 0, (NONE, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, USER): 1, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
END = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_KEEPS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {"su", "ua", "au"}
#: An edit of a state's audit at a turn: deleted, or retained, with the inserts before it.
_STEPS = ["D", "K", "R", "IK", "IR"]


class Repair:
    """The program over one conversation's turns, given one by one."""

    def __init__(self):
        self.n = 0
        # of each state: the cost of its best last retained turn, less the deletions up to and with that turn; and its audit's place among the four
        self.least: list[int | None] = [0, None, None, None]
        self.place = [0, 0, 0, 0]
        self.trail = [bytearray() for _ in range(4)]  # at each turn: 5 * state before + edit

    def add(self, initial: str, must_go: bool, truncated: bool) -> None:
        deleted = DELETE * self.n  # all turns before this one
        best = [None if m is None else (m, self.place[s], "D", s, 0) for s, m in enumerate(self.least)]
        if not must_go:
            kept = _KEEPS.get(initial)
            for role, edit, cost in ((kept, 1, 0), (USER, 2, REROLE), (ASSISTANT, 2, REROLE)):
                for before, m in enumerate(self.least):
                    inserts = GAP.get((before, role))
                    if m is None or inserts is None:
                        continue
                    step = edit + 2 * inserts
                    f = m + deleted + INSERT * inserts + cost + (TRUNCATED if truncated else 0)
                    found = (f - deleted - DELETE, self.place[before], _STEPS[step], before, step)
                    if best[role] is None or found < best[role]:
                        best[role] = found
        self.n += 1
        self.least = [None if b is None else b[0] for b in best]
        alive = sorted((b[1:3], s) for s, b in enumerate(best) if b is not None)
        for k, (_, s) in enumerate(alive):
            self.place[s] = k
        for t, b in zip(self.trail, best, strict=True):
            t.append(0 if b is None else 5 * b[3] + b[4])

    def end(self) -> tuple[int, str]:
        """The least cost, and its audit."""
        cost, _, s = min((m + DELETE * self.n + INSERT * END[s], self.place[s], s) for s, m in enumerate(self.least) if m is not None)
        out = ["I" * END[s]]
        for k in range(self.n - 1, -1, -1):
            s, step = divmod(self.trail[s][k], 5)
            out.append(_STEPS[step])
        return cost, "".join(reversed(out))


_WHITE = r"\x20\x09-\x0D"


def damage(turns: DataFrame) -> DataFrame:
    """The turns with planted faults, by crc32 of `conv_id:turn` modulo 20: columns conv_id, turn, role, text, absent (a dropped turn: it only tells that its conversation exists)."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = (F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20).alias("kind")
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("absent"), times.alias("copy"))
    return rows.drop("copy")


def _digest() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))


#: Order of a conversation's rows (nulls come first in it).
ORDER = ["turn", "role", "digest"]


def _faults(rows: DataFrame) -> DataFrame:
    """One row for equal turns of a conversation: conv_id, turn, role, digest, n (how many), blank, truncated, again (role and text seen at an earlier turn); and one row with n = 0 for each conversation."""
    slim = rows.where(~F.col("absent")).select(
        "conv_id", "turn", "role", _digest().alias("digest"), (~F.col("text").rlike(f"[^{_WHITE}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z")).alias("truncated"),
    )
    # equal rows are counted before they are shuffled; repeats are told by the turns of one digest
    per = slim.groupBy("conv_id", "digest", "turn").agg(F.count("*").alias("n"), F.first("role").alias("role"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    there = rows.select("conv_id").distinct().select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("blank"), F.lit(False).alias("truncated"), F.lit(False).alias("again"))
    return per.select("conv_id", "turn", "role", "digest", "n", "blank", "truncated", again.alias("again")).unionByName(there)


class _Walk:
    """Counts and the program of one conversation, by its rows in order."""

    def __init__(self):
        self.repair, self.blank, self.duplicate, self.truncated, self.illegal = Repair(), 0, 0, 0, 0
        self.low = self.high = self.before = None
        self.turns = 0

    def add(self, turn, role, n, blank, truncated, again):
        if not n:
            return
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1] or " "
        for k in range(n):
            twice = not blank and (again or k > 0)
            self.blank += blank
            self.duplicate += twice
            self.truncated += not blank and not twice and truncated
            self.illegal += self.before is not None and self.before + initial not in _LEGAL
            self.before = initial
            self.repair.add(initial, blank or twice, truncated)

    def row(self):
        cost, audit = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _table(names, types, rows):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _ordered(rows: DataFrame, *order) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _stream(batches, columns, start, size: int = 2048):
    """Rows of all batches as lists of plain values, with a new object for each conversation: yields (object, conv_id) when a conversation is through."""
    have, conv, what = False, None, None
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            for c, *row in zip(*(part.column(k).to_pylist() for k in range(columns)), strict=True):
                if not have or c != conv:
                    if have:
                        yield what, conv
                    have, conv, what = True, c, start()
                what.add(*row)
    if have:
        yield what, conv


def _batches(found, names, types, size: int = 256):
    rows = []
    for r in found:
        rows.append(r)
        if len(rows) >= size:
            yield _table(names, types, rows)
            rows = []
    yield _table(names, types, rows)


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for each conversation. turns: conv_id, turn (an integer), role, text, absent."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    ddl = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {', '.join(c + ' long' for c in _NUMBERS)}, audit string"
    names, types = ["conv_id", *_NUMBERS, "audit"], [to_arrow_type(turns.schema["conv_id"].dataType), *[pa.int64()] * 6, pa.string()]

    def run(batches):
        yield from _batches(((c, *w.row()) for w, c in _stream(batches, 7, _Walk)), names, types)

    rows = _ordered(_faults(turns), *ORDER).select("conv_id", "turn", "role", "n", "blank", "truncated", "again")
    return rows.mapInArrow(freed(run), ddl)


class _Writer:
    """A conversation's repaired turns, by its audit and then its rows in order."""

    def __init__(self):
        self.edits, self.numbers, self.n, self.nth = None, None, 0, 0

    def begin(self, *numbers):
        self.numbers, self.edits = numbers, iter(numbers[-1])

    def _due(self) -> str:
        self.nth += 1
        return ("user", "assistant")[(self.nth - 1) % 2]

    def lines(self, turn=None, role=None, text=None):
        """(place, edit, turn, role, text) of what is put out up to and with the next row; without one, of what is inserted at the end."""
        while (edit := next(self.edits, None)) == "I":
            self.n += 1
            yield self.n, "I", None, self._due(), ""
        if edit in (None, "D"):
            return
        if edit == "R":
            role = self._due()
        elif self.n or role[:1] != "s":  # a turn that is kept stands where its role is due, a system turn before all
            self._due()
        self.n += 1
        yield self.n, edit, turn, role, text


class _Hasher(_Writer):
    """Of the lines only the digest is kept."""

    def __init__(self):
        super().__init__()
        self.sha = hashlib.sha256()

    def _take(self, lines):
        for place, _, _, role, text in lines:
            self.sha.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())

    def add(self, late, turn, role, text, *numbers):
        if late:
            self._take(self.lines(turn, role, text))
        else:
            self.begin(*numbers)

    def row(self):
        self._take(self.lines())
        return (*self.numbers, self.sha.hexdigest())


def _with_audits(turns: DataFrame) -> DataFrame:
    """Rows of a conversation behind its audit, in order: conv_id, late (0: the audit), turn, role, text, the numbers and the audit."""
    turn = turns.schema["turn"].dataType
    none = [*(F.lit(None).cast("long").alias(c) for c in _NUMBERS), F.lit(None).cast("string").alias("audit")]
    rows = turns.where(~F.col("absent")).select("conv_id", F.lit(1).alias("late"), "turn", "role", _digest().alias("digest"), "text", *none)
    blank = [F.lit("").alias(c) for c in ("role", "digest", "text")]
    said = audits(turns).select("conv_id", F.lit(0).alias("late"), F.lit(None).cast(turn).alias("turn"), *blank, *_NUMBERS, "audit")
    return _ordered(said.unionByName(rows), "late", *ORDER).select("conv_id", "late", "turn", "role", "text", *_NUMBERS, "audit")


def repair(turns: DataFrame) -> DataFrame:
    """audits() with repaired_sha256, of the repaired `role:text` lines. turns: conv_id, turn, role, text, absent (see damage()); conversations all of whose rows are absent have zeros and an empty audit."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = turns.schema["conv_id"].dataType
    ddl = f"conv_id {kind.simpleString()}, {', '.join(c + ' long' for c in _NUMBERS)}, audit string, repaired_sha256 string"
    names, types = ["conv_id", *_NUMBERS, "audit", "repaired_sha256"], [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches):
        yield from _batches(((c, *w.row()) for w, c in _stream(batches, 12, _Hasher)), names, types)

    return _with_audits(turns).mapInArrow(freed(run), ddl)


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), edit (K, R or I), turn (null: inserted), role, text of each turn that the repair puts out."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    conv, turn = (turns.schema[c].dataType for c in ("conv_id", "turn"))
    names = ["conv_id", "place", "edit", "turn", "role", "text"]
    types = [to_arrow_type(conv), pa.int64(), pa.string(), to_arrow_type(turn), pa.string(), pa.string()]

    def lines(batches):
        have, now, w = False, None, None
        for batch in batches:
            for c, late, t, role, text, *numbers in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if have and c != now:
                    yield from ((now, *x) for x in w.lines())
                have, now = True, c
                if late:
                    yield from ((c, *x) for x in w.lines(t, role, text))
                else:
                    w = _Writer()
                    w.begin(*numbers)
        if have:
            yield from ((now, *x) for x in w.lines())

    def run(batches):
        yield from _batches(lines(batches), names, types)

    ddl = f"conv_id {conv.simpleString()}, place long, edit string, turn {turn.simpleString()}, role string, text string"
    return _with_audits(turns).mapInArrow(freed(run), ddl)


def op13_retained_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _sql() -> str:
    """Each turn is a step of a recursion that carries for every state its least cost and its least audit."""
    states = range(4)
    carried = {s: f"{{'m': w.s{s}.m + {DELETE}, 'a': w.s{s}.a || 'D'}}" for s in states}
    cases = []
    for role in states:
        options = [carried[role]]
        for before in states:
            inserts = GAP.get((before, role))
            if inserts is None:
                continue
            cost = f"w.s{before}.m + {INSERT * inserts} + case when r.truncated then {TRUNCATED} else 0 end"
            keep = f"case when r.gone or r.initial <> '{'-sua'[role]}' then null else {{'m': {cost}, 'a': w.s{before}.a || '{'I' * inserts}K'}} end"
            options.append(keep)
            if role in (USER, ASSISTANT):
                options.append(f"case when r.gone then null else {{'m': {cost} + {REROLE}, 'a': w.s{before}.a || '{'I' * inserts}R'}} end")
        cases.append(f"list_min(list_filter([{', '.join(options)}], lambda x: x is not null and x.m is not null)) as s{role}")
    ends = ", ".join(f"{{'m': s{s}.m + {INSERT * END[s]}, 'a': s{s}.a || '{'I' * END[s]}'}}" for s in states)
    nothing = "{'m': null::bigint, 'a': null::varchar}"
    return rf"""
with recursive t as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from t where kind <> 0),
o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(length(role) || ':' || role || text)) as pos,
    not regexp_matches(text, '[^ 	-
]') as blank, not regexp_matches(text, '[.!?][ 	-
]*\z') as truncated
  from d),
f as (
  select *, case when role = '' then ' ' else left(role, 1) end as initial,
    not blank and row_number() over (partition by conv_id, role, text order by pos) > 1 as again from o),
r as (select conv_id, pos, turn, role, text, initial, blank, again, not blank and not again and truncated as truncated, blank or again as gone, lag(initial) over (partition by conv_id order by pos) as before from f),
w(conv_id, pos, s0, s1, s2, s3) as (
  select conv_id, 0::bigint, {{'m': 0::bigint, 'a': ''}}, {nothing}, {nothing}, {nothing} from (select distinct conv_id from conversations)
  union all
  select w.conv_id, r.pos, {', '.join(cases)} from w join r on w.conv_id is not distinct from r.conv_id and r.pos = w.pos + 1),
e as (select conv_id, pos, list_min(list_filter([{ends}], lambda x: x.m is not null)) as best from w
  qualify row_number() over (partition by conv_id order by pos desc) = 1),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again) as duplicate,
    count(*) filter (truncated) as truncated, count(*) filter (before || initial not in ('su', 'ua', 'au')) as illegal from r group by conv_id),
u as (select conv_id, best.a as audit, unnest(range(1, length(best.a) + 1)) as k, substr(best.a, k, 1) as edit, length(replace(substr(best.a, 1, k), 'I', '')) as pos from e),
v as (select u.*, r.role, r.text, count(*) filter (edit <> 'D' and not (edit = 'K' and r.initial = 's')) over (partition by u.conv_id order by k) as nth
  from u left join r on u.edit <> 'I' and u.conv_id is not distinct from r.conv_id and u.pos = r.pos),
l as (select conv_id, string_agg(case edit when 'K' then role || ':' || text else case when nth % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'R' then text else '' end end, chr(10) order by k) as said
  from v where edit <> 'D' group by conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, best.m::bigint as cost, best.a as audit, sha256(coalesce(said, '')) as repaired_sha256
from e left join c on e.conv_id is not distinct from c.conv_id left join l on e.conv_id is not distinct from l.conv_id
"""


SQL = _sql()
