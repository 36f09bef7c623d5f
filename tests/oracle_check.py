"""Compare registered queries with their SQL.  python tests/oracle_check.py [folder] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v: object) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def connect(folder: str):  # noqa: ANN201
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def compare(spark, con, name: str, folder: str) -> str:  # noqa: ANN001
    import __spark_entry__ as entry

    started = time.perf_counter()
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted([tuple(norm(r[c]) for c in columns) for r in df.collect()])
    took = time.perf_counter() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows {len(got)} (no SQL) {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    if sorted(names) != columns:
        return f"COLUMNS {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted([tuple(norm(r[i]) for i in order) for r in rows])
    if got == want:
        return f"ok {len(got)} {took:.1f}s" + ("" if got else " EMPTY")
    extra, missing = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"DIFF spark={len(got)} sql={len(want)} {took:.1f}s\n   cols {columns}\n   spark {extra}\n   sql   {missing}"


def main() -> None:
    import __spark_entry__ as entry
    from barline.session import get_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = get_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in entry.queries():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            line = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            line = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += not line.startswith(("ok", "rows"))
        print(f"{name}: {line}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
