"""Streams over several micro-batches: nothing is lost, late rows are told apart, a stop holds; shared folder and products."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from barline import session
from barline.catalog import registry
from barline.plans import paper
from barline.sources import store
from barline.streaming import quotes as sq


def replay(spark, rows, form):
    df = spark.createDataFrame(rows, form)
    return sq.replayed(df, F.col("batch"), 1 + max(r[-1] for r in rows), "test").drop("batch")


def test_failed_series_is_retried_and_rejects_are_kept(spark):
    day = 86_400
    rows = [("a", 1, day, 1.0, 0), ("a", 2, day + 1, -1.0, 0), ("b", 1, day, 1.0, 0), ("a", 3, 2 * day, 1.0, 1), ("b", 1, day, 1.0, 1), ("c", 1, day, -1.0, 2), ("c", 2, day, 2.0, 2)]
    s = replay(spark, rows, "series string, id long, s long, value double, batch int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    plans = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "series string")
    out = sq.ingest(s, ["series", "id"], ["series"], "ts", F.col("value") > 0, "ingest", plans)
    assert sorted((r.series, r.id) for r in out["data"].collect()) == [("a", 1), ("a", 3), ("b", 1)]
    assert [(r.series, r.id, r.reason) for r in out["rejects"].orderBy("series").collect()] == [("a", 2, "invalid"), ("c", 1, "invalid")]
    assert [(r.series, r.id) for r in out["retry"].collect()] == [("c", 2)]
    got = {(r.series, r.epoch): (r.status, r.received, r.stored, r.checkpoint and int(r.checkpoint.timestamp())) for r in out["outcomes"].collect()}
    assert [got["a", e] for e in range(3)] == [("FAILED", 2, 0, None), ("UPDATED", 1, 2, 2 * day), ("NO_DATA", 0, 0, 2 * day)]
    assert [got["b", e][0] for e in range(3)] == ["UPDATED", "CURRENT", "NO_DATA"]
    assert got["c", 2][0] == "FAILED" and {got["d", e][0] for e in range(3)} == {"NO_DATA"}


def test_journal_rejects_with_reasons(spark):
    rows = [(1, 10, 1, "Q", 0), (1, 20, 2, "Q", 0), (1, 15, 3, "Q", 1), (1, 20, 4, "FINALIZED", 1), (1, 30, 5, "Q", 2), (1, 5, 6, "Q", 2)]
    out = sq.run_to_table(sq.chained(replay(spark, rows, "session_id long, ts long, entry long, kind string, batch int")), "chain")
    got = {r.entry: (r.accepted, r.sequence, r.reason) for r in out.collect()}
    assert got == {1: (True, 1, None), 2: (True, 2, None), 3: (False, None, "out_of_order"), 4: (True, 3, None), 5: (False, None, "after_final"), 6: (False, None, "after_final")}


def test_stop_holds_over_late_rows_and_days_until_reset(spark):
    d = 86_400
    rows = [(1, d, 1, -70.0, False, 0), (1, 5, 2, 10.0, False, 1), (1, 3 * d, 3, 5.0, False, 1), (1, 3 * d + 1, 4, 0.0, True, 2), (1, 3 * d + 2, 5, -10.0, False, 2), (1, d + 1, 6, -20.0, False, 3)]
    out = sq.run_to_table(sq.loss_latch(replay(spark, rows, "account long, ts long, entry long, delta double, reset boolean, batch int"), -60.0), "latch")
    got = {r.entry: (r.daily_pnl, r.stopped) for r in out.collect()}
    assert got == {1: (-70.0, True), 2: (10.0, True), 3: (5.0, True), 4: (0.0, False), 5: (-10.0, False), 6: (-20.0, False)}


def test_refreshes_add_up(spark):
    path = f"{session.shared_folder(spark)}/refresh-{spark.sparkContext.applicationId}"
    table = lambda *rows: spark.createDataFrame(rows, "k int, v int")
    store.refresh_derived(spark, path, table((1, 0), (2, 0)), ["k"])
    store.refresh_derived(spark, path, table((1, 1)), ["k"])
    out = store.refresh_derived(spark, path, table((3, 3)), ["k"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1), (2, 0), (3, 3)]


def test_products_are_deleted_on_close(spark):
    kept = session.written(spark.range(3), "closing")
    folder = kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert glob.glob(f"{folder}/*.parquet")
    assert registry.close(spark) > 0 and not glob.glob(f"{folder}/*")


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_replayed_batches_are_written_in_parallel_and_stay_whole(spark):
    rows = spark.range(90_000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("batch"))
    stream = sq.replayed(rows, F.col("batch"), 3, "parallel")
    seen = []

    def note(batch, epoch):
        r = batch.agg(F.collect_set("batch").alias("b"), F.count("*").alias("n")).first()
        seen.append((epoch, r.b, r.n))

    stream.writeStream.foreachBatch(note).option("checkpointLocation", f"{session.shared_folder(spark)}/parallel-{spark.sparkContext.applicationId}").trigger(availableNow=True).start().awaitTermination()
    assert seen == [(b, [b], 30_000) for b in range(3)]
    folder = max(glob.glob(f"{session.shared_folder(spark)}/parallel-arrivals-*"), key=os.path.getmtime)
    assert [len(glob.glob(f"{folder}/{b}/*.parquet")) for b in range(3)] == [3, 3, 3]


def test_chains_of_many_sessions_keep_to_plain_python(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(60), i, "FINALIZED" if rng.random() < 0.03 else "Q", rng.randrange(4)) for i in range(3000)]
    want, heads = {}, {}
    for s, ts, entry, kind, _ in sorted(rows, key=lambda r: (r[4], r[1], r[2])):
        sequence, head, last, done = heads.get(s, (0, paper.NO_HASH, -1, False))
        if done or ts < last:
            want[entry] = (None, None, "after_final" if done else "out_of_order")
            continue
        digest = paper.entry_hash(entry, kind, head, sequence + 1, s, ts)
        want[entry], heads[s] = (sequence + 1, digest, None), (sequence + 1, digest, ts, kind == "FINALIZED")
    job = sq.chained(replay(spark, rows, "session_id long, ts long, entry long, kind string, batch int"))
    assert {r.entry: (r.sequence, r.record_hash, r.reason) for r in sq.run_to_table(job, "chain").collect()} == want


def test_latches_of_many_accounts_keep_to_plain_python(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(30), rng.randrange(6 * 86_400), i, float(rng.randrange(-40, 30)), rng.random() < 0.03, rng.randrange(4)) for i in range(2000)]
    want, held = {}, {}
    for account, ts, entry, delta, reset, _ in sorted(rows, key=lambda r: (r[5], r[1], r[2])):
        days, stopped = ({}, False) if reset else held.get(account, ({}, False))
        days[ts // 86_400] = days.get(ts // 86_400, 0.0) + (0.0 if reset else delta)
        stopped = not reset and (stopped or days[ts // 86_400] <= -60.0)
        held[account], want[entry] = (days, stopped), (days[ts // 86_400], stopped)
    job = sq.loss_latch(replay(spark, rows, "account long, ts long, entry long, delta double, reset boolean, batch int"), -60.0)
    assert {r.entry: (r.daily_pnl, r.stopped) for r in sq.run_to_table(job, "latch").collect()} == want and any(s for _, s in want.values())
