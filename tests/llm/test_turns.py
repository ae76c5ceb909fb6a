"""Conversation repair against an exhaustive search and against its SQL on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest

from readloom.llm import turns
from tests import oracle

TURNS = "conv_id long, turn long, role string, text string, audit string"
_GOOD = re.compile(r"(s?(ua)+)?")


def search(rows, most=8):
    """The cheapest audit by trying all edits. rows: (initial, must go, truncated)."""
    best = None
    n = len(rows)
    for inserts in itertools.product(range(3), repeat=n + 1):
        if sum(inserts) > most:
            continue
        for edits in itertools.product("DKR", repeat=n):
            if any(go and e != "D" for e, (_, go, _) in zip(edits, rows)):
                continue
            audit = "I" * inserts[0] + "".join(e + "I" * k for e, k in zip(edits, inserts[1:]))
            cost = 3 * sum(inserts) + sum({"D": 4, "R": 3, "K": 0}[e] + (3 if t and e != "D" else 0) for e, (_, _, t) in zip(edits, rows))
            if best is not None and (cost, audit) >= best:
                continue
            free = "".join({"K": re.escape(i), "R": "[ua]", "D": ""}[e] + "[ua]" * k for e, k, (i, _, _) in zip(edits, inserts[1:], rows))
            shape = "[ua]" * inserts[0] + free
            if any(re.fullmatch(shape, s) for s in ("", *(p + "ua" * k for p in ("", "s") for k in range(1, n + most)))):
                best = cost, audit
    return best


@pytest.mark.parametrize("seed", range(4))
def test_program_equals_exhaustive_search(seed):
    rng = random.Random(seed)
    for _ in range(12):
        rows = [(rng.choice("suuaaax"), rng.random() < 0.2, rng.random() < 0.25) for _ in range(rng.randint(0, 4))]
        r = turns.Repair()
        for x in rows:
            r.add(*x)
        assert r.end() == search(rows, 5), rows


def _lines(rows):
    """Roles and texts that a repaired conversation must have, from its audit alone."""
    out, nth = [], 0
    audit, said = rows
    it = iter(said)
    for e in audit:
        due = ("user", "assistant")[nth % 2]
        if e == "I":
            out.append((due, ""))
            nth += 1
            continue
        role, text = next(it)
        if e == "D":
            continue
        out.append((due if e == "R" else role, text))
        nth += not (e == "K" and role[:1] == "s")
    return out


ODD = [
    (1, 0, "system", "You are."), (1, 1, "user", "Why?"), (1, 1, "user", "Why?"), (1, 2, "assistant", None), (1, 3, None, "x."), (1, 9, "assistant", "Because"),
    (2, None, "user", "first."), (2, None, "user", "first."), (2, 5, "assistant", "ok.\u0085"), (2, 6, "assistant", " \t\n"), (2, 7, "tool", "out!"), (2, 8, "", "no role."),
    (None, 0, "user", "a conversation without id."), (None, None, None, None), (3, 0, "system", "alone."), (4, 0, "assistant", "hello.\n\n"), (4, 1, "user", "b?" + " " * 5000),
    (5, 3, "user", "same."), (5, 3, "assistant", "tie."), (5, 3, "user", "tie."), (6, 0, "unknown", "u."), (6, 1, "assistant", "fine. " * 4000),
]


def _table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TURNS)


def test_odd_rows_equal_sql_and_are_repaired(spark, tmp_path):
    many = ODD + [(c, t, random.Random(c * 50 + t).choice(["user", "assistant", "system"]), f"line {t % 3}{'.' if t % 4 else ''}") for c in range(10, 40) for t in range(c % 13)]
    table = _table(spark, many).cache()
    damaged = turns.damage(table)
    got = turns.repair(damaged)
    con = oracle.duckdb.connect()
    con.register("conversations", table.drop("audit").toArrow())
    assert oracle.spark_rows(got) == oracle.duck_rows(con, turns.SQL)
    lines = {}
    for r in sorted(turns.repaired(damaged).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(r)
    for r in got.collect():
        own = lines.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == r.repaired_sha256
        assert _GOOD.fullmatch("".join(x.role[:1] for x in own)) and [x.place for x in own] == list(range(1, len(own) + 1))
        assert "".join(x.edit for x in own) == r.audit.replace("D", "") and all((x.turn is None and x.text == "") for x in own if x.edit == "I")


def test_repair_without_damage(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "u."), (1, 2, "assistant", "a."), (2, 0, "assistant", "a."), (2, 1, "user", "cut")]
    table = _table(spark, rows).selectExpr("conv_id", "turn", "role", "text", "false as absent")
    got = {r.conv_id: r for r in turns.repair(table).collect()}
    assert (got[1].audit, got[1].cost, got[1].illegal) == ("KKK", 0, 0)
    assert got[1].repaired_sha256 == hashlib.sha256(b"system:s.\nuser:u.\nassistant:a.").hexdigest()
    said = [("assistant", "a."), ("user", "cut")]
    assert [(r.role, r.text) for r in turns.repaired(table.where("conv_id = 2")).collect()] == _lines((got[2].audit, said))


def test_absent_and_empty(spark):
    table = _table(spark, [(1, 0, "user", "x.")]).selectExpr("conv_id", "turn", "role", "text", "true as absent")
    (r,) = turns.repair(table).collect()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turns.repair(turns.damage(_table(spark, []))).collect() == [] and turns.repaired(table).collect() == []


def test_a_long_conversation_takes_time_in_proportion(spark):
    n = 60_000
    table = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 5 = 0, 'user', 'assistant') as role", "concat('t', id, '.') as text", "false as absent")
    (r,) = turns.repair(table).collect()
    assert len(r.audit.replace("I", "")) == n and r.blank == r.duplicate == r.gaps == 0
