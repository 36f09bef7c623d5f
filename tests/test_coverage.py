"""Interval coverage against its SQL where many intervals are equal."""

from __future__ import annotations

import duckdb

import __spark_entry__ as entry


def test_equal_intervals_are_counted_once(spark, tmp_path):
    con = duckdb.connect()
    con.execute(
        """CREATE TABLE orders AS SELECT 42 * i + 22 AS o_orderkey, 1::BIGINT AS o_custkey, 'F' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice,
        TIMESTAMP '1996-03-01' + to_days(CAST(10 * (i % 20) AS INT)) AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(30000) t(i)"""
    )
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    got = [tuple(r) for r in entry.queries()["j12_interval_coverage"](spark, str(tmp_path)).collect()]
    assert [r[:3] for r in got] == [("1-URGENT", 20 * 2 * 86_400, 20)]
    assert all(con.execute(entry.oracle_sql()["j12_interval_coverage"]).fetchall() == got for _ in range(3))
