"""Conversation repair against all edits tried out, in whole and in tiny blocks, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import product

import duckdb
import pytest
from conftest import SMALL, rows_equal
from pyspark.sql import functions as F

from careerloom.llm import conversations as C
from careerloom.llm import queries

GOAL = re.compile(r"(s?(ua)+)?")


def lacks(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def tried_out(rows):
    """The least (cost, audit) over all edits with up to two turns put in at a place, and the lines."""
    faults = lacks(rows)
    puts = ["", *"ua", "uu", "ua", "au", "aa"]
    best = None
    for gaps in product(puts, repeat=len(rows) + 1):
        for acts in product("DKua", repeat=len(rows)):
            cost, audit, roles, lines = 5 * sum(map(len, gaps)), "", "", []
            for i, act in enumerate(acts):
                _, role, text = rows[i]
                audit += "I" * len(gaps[i]) + {"D": "D", "K": "K"}.get(act, "R")
                roles += gaps[i]
                lines += [{"u": "user:", "a": "assistant:"}[g] for g in gaps[i]]
                if act == "D":
                    cost += 2
                    continue
                if faults[i] in ("blank", "duplicate"):
                    break
                cost += 5 * (faults[i] == "truncated") + (act != "K")
                roles += (role[:1] or "?") if act == "K" else act
                lines.append({"K": role, "u": "user", "a": "assistant"}[act] + ":" + text)
            else:
                audit, roles = audit + "I" * len(gaps[-1]), roles + gaps[-1]
                lines += [{"u": "user:", "a": "assistant:"}[g] for g in gaps[-1]]
                if GOAL.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, lines
    return best


def some(rng, n):
    return [(rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "no", " ", "Why?\n", "é!"])) for _ in range(n)]


def test_edits_are_the_cheapest_of_all():
    rng = random.Random(11)
    convs = [some(rng, n) for n in [0, 1, 1, 2, 2, 2, 3, 3, 3, 3]]
    got = C.solved([C.Turns(*([r[k] for r in c] for k in range(3))) for c in convs])
    for rows, (gaps, blank, duplicate, truncated, illegal, cost, audit, digest) in zip(convs, got, strict=True):
        want = tried_out(rows)
        assert (cost, audit) == want[:2] and digest == hashlib.sha256("\n".join(want[2]).encode()).hexdigest()
        assert [blank, duplicate, truncated] == [lacks(rows).count(x) for x in ("blank", "duplicate", "truncated")]
        assert illegal == sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        turns = {r[0] for r in rows} - {None}
        assert gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)


def in_order(rows):
    """Tied turns here have texts of under 64 characters, and equal role and text wherever role and start are equal."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


@pytest.mark.parametrize("block", [2048, 3, 1])
def test_blocks_give_what_whole_conversations_do(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(block)
    convs = {c: some(rng, n) for c, n in [(1, 60), (2, 1), (3, 7), (None, 25), (5, 2), (6, 400)]}
    # a conversation none of whose turns are left, and extra columns of clashing names
    rows = [(c, *r, True, "mine", 3) for c, rs in convs.items() for r in rs] + [(7, 1, "user", "gone.", False, "mine", 3), (1, 2, "user", "gone.", None, "x", 4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, here boolean, audit string, block int").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in C.repair(df, F.col("here")).collect()}
    assert set(got) == {*convs, 7} and got[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for c, rs in convs.items():
        ordered = in_order(rs)
        assert got[c] == C.solved([C.Turns(*([r[k] for r in ordered] for k in range(3)))])[0]


def test_hot_copies_nulls_and_an_empty_table(spark):
    """One conversation of copies of one row, over several ranges: the first copy stays."""
    df = spark.createDataFrame([(None, None, None, None)] * 3 + [(4, 1, "user", "Hi.")] * 500, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in C.repair(df).collect()}
    assert (got[4].duplicate, got[4].cost, got[4].audit) == (499, 1000, "D" * 500)
    assert (got[None].blank, got[None].audit, got[None].gaps) == (3, "DDD", 0)
    assert C.repair(df.limit(0)).count() == 0 and C.repair(C.damaged(df.limit(0)), F.col("present")).count() == 0


def test_long_texts(spark):
    text = "word " * 2_000_000 + "."
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "user", "So.")], "conv_id long, turn long, role string, text string")
    (got,) = C.repair(df).collect()
    assert (got.cost, got.audit) == (2, "KKD")
    assert got.repaired_sha256 == hashlib.sha256(f"user:{text}\nassistant:{text}".encode()).hexdigest()


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    df = queries.queries()["op11_conversations"](spark, sf)
    rows_equal([tuple(r) for r in df.collect()], df.columns, duck.execute(queries.oracle_sql()["op11_conversations"]))
