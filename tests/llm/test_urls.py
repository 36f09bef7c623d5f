"""URL filtering against the SQL that counts every subset of tokens, and on edge rows."""

from __future__ import annotations

import random

import duckdb
import pandas as pd

from barline.llm import urls

FORM = "page_id long, url string, host int, verdict int, tokens string"


def agree(spark, rows: list[tuple]) -> list:
    df = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], FORM)
    got = sorted((tuple(r) for r in urls.judged(df).collect()), key=repr)
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["page_id", "url"]).astype({"page_id": "Int64"}))
    con.execute("CREATE TABLE pages AS SELECT CAST(page_id AS BIGINT) AS page_id, CAST(url AS VARCHAR) AS url FROM frame")
    cur = con.execute(urls.oracle_sql())
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in ("page_id", "host", "path", "rule", "verdict", "mined")]
    assert got == sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
    return got


def test_listed_and_mined_rules(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        host = rng.choice(["a.example.net", "example.com", "m.shop.org", "b.example.org", "X.EXAMPLE.COM", "net", "evilnet.com"])
        rows.append((i, f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(9999)}{rng.choice(['', '/', '.html', '?page=2&ref=x', '#top'])}"))
    got = {r[0]: r for r in agree(spark, rows)}
    assert {r[3] for r in got.values()} == {None, "net/", "example.net/en/", "example.com/de/", "org/fr/"}
    assert any(r[5] for r in got.values())


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "://"), (None, "HTTP://NET/a"), (5, "http://net"), (6, "http://a.net?x/"), (7, "ftp://x.example.net/en/" + "y/" * 30_000), (8, "http://é.ORG/fr/É"), (8, "http://é.ORG/fr/É"), (9, "http://h#f?x=/y"), (10, "a b://h i/fr/ j")]
    got = agree(spark, rows)
    assert [r for r in got if r[0] == 1] == [(1, "", "", None, "allow", None)] and sum(r[0] == 8 for r in got) == 2


def test_no_labels_and_no_rows(spark):
    assert {r[4] for r in agree(spark, [(1, "http://q.com/en/"), (2, None)])} == {"allow"}
    assert urls.judged(spark.createDataFrame([], FORM)).collect() == []
