"""Quotation links on written conversations, against the SQL and by hand."""

from __future__ import annotations

import random

import duckdb
import pandas as pd

from barline.llm import quotes
from tests.oracle_check import norm

FORM = "conv_id long, turn long, role string, text string, level int, row string"
NAMES = ["conv_id", "turn", "role", "text", "level", "row"]


def agree(spark, rows: list[tuple]) -> list[dict]:
    got = [r.asDict() for r in quotes.linked(spark.createDataFrame([(*r, 1, "x") for r in rows], FORM)).collect()]
    con = duckdb.connect()
    frame = pd.DataFrame([(*r, 1, "x") for r in rows], columns=NAMES).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("frame", frame)
    con.execute("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(role AS VARCHAR) AS role, CAST(text AS VARCHAR) AS text FROM frame")
    cur = con.execute(quotes.oracle_sql())
    names = [d[0] for d in cur.description]
    want = sorted(tuple(norm(v) for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall())
    assert sorted(tuple(norm(r[k]) for k in sorted(r)) for r in got) == want
    return got


def test_levels_parents_and_order(spark):
    rows = [
        (1, 0, "user", "The first statement of it all.\nIt has a second line here."),
        (1, 1, "assistant", "Ann wrote:\n> The first statement of it all.\n> It has a second line here.\n\nAn answer that is long."),
        (1, 2, "user", "> > It has a second line here.\n> An answer that is long.\nAnother word on this."),
        (2, 0, "user", ">  Another   WORD on this.\nFrom elsewhere, at length."),
        (2, 1, "user", ">>> It has a second line here.\nOnly the old quote."),
        (3, 0, "user", "no quotes at all"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in agree(spark, rows)}
    assert [(got[k]["up_conv"], got[k]["up_turn"], got[k]["depth"], got[k]["thread_id"], got[k]["position"]) for k in sorted(got)] == [
        (None, None, 0, 1, 1), (1, 0, 1, 1, 2), (1, 1, 2, 1, 3), (1, 2, 3, 1, 4), (1, 0, 1, 1, 5), (None, None, 0, 3, 1),
    ]
    assert got[1, 1]["body"] == "An answer that is long." and got[1, 2]["chat"] == "<|user|>\nAnother word on this.<|end|>"


def test_edge_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "user", ""), (None, 0, "user", "> anything quoted here"), (2, None, "user", "anything quoted here"), (3, 0, "user", "same same same same"), (3, 0, "user", "same same same same"), (3, 1, "user", "> same same same same\nyes"), (4, 0, "user", "\n".join(["> same same same same", "word " * 30] * 300))]
    agree(spark, rows)


def test_random_conversations(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(4)) for _ in range(25)]
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 9)):
            text = []
            for _ in range(rng.randint(0, 6)):
                text.append(rng.choice(["", "> ", ">> ", " > > ", ">"]) + rng.choice([*pool, ""]))
            rows.append((c, t, rng.choice(["user", "assistant"]), "\n".join(text)))
    agree(spark, rows)


def test_empty_table(spark):
    assert quotes.linked(spark.createDataFrame([], FORM)).collect() == []


def test_short_quotes_link_within_their_conversation_only(spark):
    rows = [(1, 0, "user", "Yes, do it"), (1, 1, "user", "something else entirely"), (1, 2, "assistant", "> Yes, do it\nDone."), (2, 0, "user", "> Yes, do it\nNot here."), (2, 1, "user", "Yes, do it"), (2, 2, "user", ">> do it\n> Yes, do it\nHere.")]
    got = {(r["conv_id"], r["turn"]): (r["up_conv"], r["up_turn"], r["depth"]) for r in agree(spark, rows)}
    assert got[1, 2] == (1, 0, 1) and got[2, 0] == (None, None, 0) and got[2, 2] == (2, 1, 1)
