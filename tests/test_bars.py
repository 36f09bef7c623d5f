"""Bars, feeds, resampling, intervals, first touch, experts, status rules."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from barline.functions import labels
from barline.operators import evidence as ev
from barline.operators import features, intervals, outcomes, resample, splits
from barline.session import Study
from barline.sources import feeds, store

START = 1_700_000_400 // 3600 * 3600


def sided(spark, starts, step=60):
    rows = [("A/USD", "1min", "B", START + s * step, 1.0 + i, 1.5 + i, 0.5 + i, 1.25 + i, None) for i, s in enumerate(starts)]
    d = spark.createDataFrame(rows, "pair string, timeframe string, offer_side string, t long, open double, high double, low double, close double, volume double")
    return d.withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_only_complete_aligned_groups_are_resampled(spark):
    full = resample.resample(sided(spark, range(5)), 60, 5).first()
    assert (full.open, full.close, full.high, full.low, full.volume) == (1.0, 5.25, 5.5, 0.5, None)
    assert resample.resample(sided(spark, range(4)), 60, 5).count() == 0
    late = resample.resample(sided(spark, range(1, 10)), 60, 5).collect()
    assert len(late) == 1 and late[0].ts.minute % 5 == 0
    assert resample.resample_pairs(sided(spark, [0, 1, 2, 4, 5]), 60).count() == 2


def line(ts, **change):
    bar = {"timestamp": ts, **{f"{s}_{f}": v for s in ("bid", "ask") for f, v in zip(("open", "high", "low", "close"), (1.0, 1.2, 0.9, 1.1))}}
    return {**bar, **change}


def test_feed_shapes_and_rejections(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text("\n".join(json.dumps(x) for x in [{"month_start": "2024-01", "bars": [line(2000), line(1000)]}, line(3000)]))
    got = feeds.feed_bars(feeds.feed_lines(spark, str(good)))
    assert sorted(r.ts.second for r in got.collect()) == [1, 2, 3]
    named = lambda pair, *lines: "\n".join(json.dumps({"pair": pair, **x}) for x in lines)
    (tmp_path / "feeds").mkdir()
    (tmp_path / "feeds" / "a.jsonl").write_text(named("A/B", {"bars": [line(2000), line(1000)]}, line(3000)) + "\n" + named("C/D", {"bars": []}, {"bars": []}))
    (tmp_path / "feeds" / "b.jsonl").write_text(named("E/F", {"bars": [line(2000)]}, {"bars": []}, line(2000)))
    report = {r.pair: (r.rows, r.reason) for r in feeds.feed_report(spark, str(tmp_path / "feeds")).collect()}
    assert report == {"A/B": (3, None), "C/D": (0, "no bars"), "E/F": (2, "duplicate timestamps")}
    with pytest.raises(Exception, match="rejected feed: (C/D: no bars|E/F: duplicate timestamps)"):
        feeds.good_feeds(spark, str(tmp_path / "feeds")).collect()
    for i, bad in enumerate([line(1000, bid_high=0.5), line(1000, bid_open=0.0), line(1000.5), line(0), line(1000, ask_low=None)]):
        f = tmp_path / f"bad{i}.jsonl"
        f.write_text(json.dumps(bad))
        with pytest.raises(Exception, match="invalid feed bar"):
            feeds.feed_bars(feeds.feed_lines(spark, str(f))).collect()
    broken = tmp_path / "broken.jsonl"
    broken.write_text("{not json")
    with pytest.raises(Exception):
        feeds.feed_lines(spark, str(broken)).collect()


def test_crossed_bars_are_dropped_or_fail_the_pair(spark):
    d = spark.range(1001).select(F.lit("A").alias("pair"), *[F.lit(1.0).alias(f"bid_{f}") for f in ("open", "close")], F.lit(1.1).alias("ask_open"),
                                 F.when(F.col("id") == 0, 0.9).otherwise(1.1).alias("ask_close"))
    assert feeds.without_crossed(d).count() == 1000
    with pytest.raises(Exception, match="too many crossed bars"):
        feeds.without_crossed(d.limit(500).unionByName(d.filter("ask_close < 1"))).collect()


def test_timestamps(spark):
    rows = [("1700000000",), ("1700000000123",), ("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",)]
    got = [r.m for r in spark.createDataFrame(rows, ["v"]).select(feeds.epoch_millis("v").alias("m")).collect()]
    assert got == [1700000000000, 1700000000123, 1704067200000, None]


def test_append_is_idempotent(spark, tmp_path):
    d = sided(spark, range(5))
    path = str(tmp_path / "bars")
    assert store.append_bars(spark, path, d) == 5
    assert store.append_bars(spark, path, d) == 0
    assert store.append_bars(spark, path, sided(spark, range(3, 8))) == 3


def test_interval_coverage(spark):
    rows = [("s", 0, 10), ("s", 5, 20), ("s", 20, 30), ("s", 40, 50), ("s", 90, 200), ("t", 0, 100)]
    d = spark.createDataFrame(rows, ["series", "x", "y"]).select("series", F.timestamp_seconds("x").alias("requested_from"), F.timestamp_seconds("y").alias("requested_to"))
    d = d.withColumns({"continuity_state": F.lit("COMPLETE"), "received_rows": F.lit(1), "source_hash": F.lit("a" * 64), "evidence_hash": F.lit("b" * 64)})
    need = spark.createDataFrame([("s", 5, 100), ("t", 0, 100), ("u", 0, 10)], ["series", "x", "y"]).select(
        "series", F.timestamp_seconds("x").alias("required_from"), F.timestamp_seconds("y").alias("required_to"))
    got = {r.series: (r.covered_s, r.uncovered_s, r.complete_windows, r.complete) for r in intervals.coverage(d, need).collect()}
    assert got == {"s": (45, 50, 3, False), "t": (100, 0, 1, True), "u": (0, 10, 0, False)}
    tiny = {(r.a.timestamp(), r.b.timestamp()) for r in intervals.merged_intervals(d.select("series", F.col("requested_from").alias("a"), F.col("requested_to").alias("b")), ["series"], block_s=7).filter("series = 's'").collect()}
    assert tiny == {(0.0, 30.0), (40.0, 50.0), (90.0, 200.0)}


def test_first_touch_rules(spark):
    rows = [(0, 10.0, 10.0, 10.0), (1, 10.5, 9.8, 10.0), (2, 11.5, 9.9, 11.0), (3, 11.5, 8.0, 9.0), (4, 9.0, 9.0, 9.0)]
    d = spark.createDataFrame(rows, ["i", "bid_high", "bid_low", "bid_close"]).withColumns(
        {"pair": F.lit("A"), "ts": F.timestamp_seconds(F.col("i") * 600), "pos": F.col("i"), "bars": F.lit(5), "ask_high": F.col("bid_high"), "ask_low": F.col("bid_low"), "ask_close": F.col("bid_close")})
    got = {(r.pos, r.direction): r.hit for r in outcomes.first_touch(d, Study(), 3, F.lit(1.0), F.lit(1.0)).collect()}
    assert got[(0, "long")] is True and got[(0, "short")] is False
    assert got[(2, "long")] is False and got[(3, "long")] is None


def test_global_split_purges_the_boundary(spark):
    d = spark.range(10).select(F.lit("A").alias("pair"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.timestamp_seconds((F.col("id") + 1) * 600).alias("target_end"), F.lit(1).alias("horizon"))
    got = [r.global_split for r in splits.with_global_split(d).orderBy("ts").collect()]
    assert got == ["discovery"] * 5 + ["purged_boundary"] + ["confirmation"] * 4
    assert [r.split for r in splits.with_pair_split(d, 600).orderBy("ts").collect()] == got


def test_expert_votes(spark):
    rows = [(1, "BUY", 0.9), (1, "BUY", 0.8), (1, "SELL", 0.7), (2, "BUY", 0.9), (3, "BUY", 0.5), (3, "NO_TRADE", 0.9), (4, "BUY", 0.9), (4, "SELL", 0.8)]
    got = {r.d: (r.action, r.direction) for r in ev.expert_consensus(spark.createDataFrame(rows, ["d", "direction", "confidence"]), ["d"]).collect()}
    assert got == {1: ("ABSTAIN", None), 2: ("ROUTE", "BUY"), 3: ("ABSTAIN", None), 4: ("ABSTAIN", None)}


def test_regimes_and_status(spark):
    rows = [(1.0, 0.2, 0.0, 1.0, "breakout_up"), (1.0, 0.6, 1.0, 0.0, "high_vol_trend_up"), (-1.0, 0.5, 1.0, 0.0, "high_volatility_range"), (-1.0, 0.5, 0.0, 0.0, "trend_down"), (1.0, 0.1, -1.0, 0.0, "range_low_vol"), (1.0, 0.1, 0.0, 0.0, "range_normal")]
    d = spark.createDataFrame(rows, ["t", "s", "z", "b", "want"]).withColumn("got", labels.regime(F.col("t"), F.col("s"), F.col("z"), F.col("b")))
    assert d.filter("got != want").count() == 0
    cells = [(120, 1.0, 2.0, 1.0, "STRONG_CONTEXT"), (30, -1.0, 0.5, 0.0, "NO_TRADE"), (29, 9.0, 9.0, 1.0, "UNKNOWN"), (50, 1.0, 2.0, 1.0, "WATCH_CONTEXT"), (50, 1.0, None, 1.0, "NO_TRADE")]
    s = spark.createDataFrame(cells, "n int, expectancy double, profit_factor double, stability double, want string").withColumn("got", ev.atlas_status(F.lit(None).cast("double")))
    assert s.filter("got != want").count() == 0


def test_market_state_needs_61_bars(spark):
    d = spark.range(61).select(F.lit("A").alias("pair"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), *[(1.0 + F.col("id") / 100).alias(c) for c in ("bid_high", "bid_low", "bid_close", "ask_close")], F.lit(None).cast("double").alias("spread_close"))
    study = Study(interval_s=600)
    assert features.market_states(features.positioned(d, study), study).count() == 1
    assert features.market_states(features.positioned(d.limit(60), study), study).count() == 0


def test_votes_on_the_threshold_do_not_depend_on_their_order(spark):
    buys = [0.9, 0.8, 0.5 + 0.07 * 5]  # 2.55 in all, added in doubles 2.5500000000000003 or 2.55 by order; a sell of 0.85 is a quarter
    rows = [(d, "BUY", c) for d, order in enumerate(itertools.permutations(buys)) for c in order] + [(d, "SELL", buys[2]) for d in range(6)]
    votes = spark.createDataFrame(rows, ["d", "direction", "confidence"]).coalesce(1).withColumn("strength", F.lit(1.0))
    got = ev.expert_consensus(votes, ["d"]).collect()
    assert {(r.action, r.direction, r.confidence) for r in got} == {("ROUTE", "BUY", 0.75)} and len(got) == 6
    got = ev.domain_consensus(votes, ["d"], F.lit(1.0)).collect()
    assert {(r.consensus, r.confidence, len(r.reasons)) for r in got} == {("BUY", 0.75, 0)} and len(got) == 6
