"""Blocked windows equal plain windows, whatever the block size."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.operators import features, neighbours, outcomes, paths
from barline.operators.ordering import prefix, time_block, with_positions
from barline.session import Study

STUDY = Study(interval_s=600, lookback=6, history=20, neighbours=8, k_values=(2, 4), horizons=(1, 2, 3), block_rows=10_000)
TINY = replace(STUDY, block_rows=16)


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(5)
    rows = []
    for pair in ("AAA/USD", "BBB/JPY"):
        price = 1.0
        for i in range(140):
            if i in (50, 51, 90):
                continue
            o, c = price, price + rng.uniform(-0.01, 0.01)
            hi, lo, s = max(o, c) + rng.uniform(0, 0.005), min(o, c) - rng.uniform(0, 0.005), rng.choice([0.0001, 0.0002, 0.0003])
            rows.append((pair, 1_700_000_400 + 600 * i, o, hi, lo, c, o + s, hi + s, lo + s, c + s))
            price = c
    names = "bid_open bid_high bid_low bid_close ask_open ask_high ask_low ask_close".split()
    d = spark.createDataFrame(rows, ["pair", "t", *names]).withColumn("ts", F.timestamp_seconds("t")).drop("t").withColumn("spread_close", F.lit(None).cast("double"))
    return d


def table(df, *keys):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.orderBy(*keys).collect()]


def test_positions_are_row_numbers_in_many_blocks(spark, bars):
    d = with_positions(bars, ["pair"], ["ts"], time_block("ts", 600 * 7), total="n")
    w = Window.partitionBy("pair").orderBy("ts")
    d = d.withColumn("want", F.row_number().over(w) - 1).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("pair")))
    assert d.filter((F.col("want") != F.col("pos")) | (F.col("n") != F.col("all"))).count() == 0


def test_states_and_outcomes_do_not_depend_on_block_size(bars):
    one, many = features.positioned(bars, STUDY), features.positioned(bars, TINY)
    cols = ["pair", "ts", *features.DISTANCE_FEATURES, "breakout"]
    assert table(features.states(one, STUDY).select(cols), "pair", "ts") == table(features.states(many, TINY).select(cols), "pair", "ts")
    o = ["pair", "ts", "horizon", "direction", "entry", "exit", "move", "mfe", "mae"]
    assert table(outcomes.outcomes(one, STUDY).select(o), *o[:4]) == table(outcomes.outcomes(many, TINY).select(o), *o[:4])


def test_records_do_not_depend_on_block_size(bars):
    cols = ["pair", "ts", "horizon", "k", "agreement", "median_distance", "outcome_pips"]
    a = neighbours.records(neighbours.study_states(features.positioned(bars, STUDY), STUDY), STUDY).select(cols)
    b = neighbours.records(neighbours.study_states(features.positioned(bars, TINY), TINY), TINY).select(cols)
    rows = table(a, "pair", "ts", "horizon")
    assert rows and rows == table(b, "pair", "ts", "horizon")


def test_prefix_sum_and_maximum_over_blocks(spark):
    d = spark.range(200).select((F.col("id") % 2).alias("g"), F.col("id"), ((F.col("id") * 37) % 101 - 50).cast("double").alias("v"))
    block = F.floor(F.col("id") / 16)
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    s = prefix(d, ["g"], ["id"], block, "s", F.col("v")).withColumn("want", F.sum("v").over(w))
    assert s.filter(F.abs(F.col("s") - F.col("want")) > 1e-9).count() == 0
    m = prefix(d, ["g"], ["id"], block, "m", F.col("v"), how="max", inclusive=False).withColumn("want", F.max("v").over(before))
    assert m.filter(~F.col("m").eqNullSafe(F.col("want"))).count() == 0


def test_drawdown_of_a_hot_group_in_many_blocks(spark):
    rng = random.Random(1)
    values = {0: [rng.uniform(-1, 1) for _ in range(300)], 1: [2.0, 2.0, -1.0], 2: [-3.0, 1.0]}
    rows = [(g, i, v) for g, vs in values.items() for i, v in enumerate(vs)]
    d = spark.createDataFrame(rows, ["g", "i", "v"])
    got = {r.g: (r.max_drawdown, r.net_profit) for r in paths.drawdown(d, ["g"], "v", ("i",), F.floor(F.col("i") / 7)).collect()}
    for g, vs in values.items():
        cum = peak = worst = 0.0
        for v in vs:
            cum += v
            peak = max(peak, cum)
            worst = max(worst, peak - cum)
        assert got[g] == pytest.approx((worst, sum(vs)))
    assert got[1] == (1.0, 3.0)


def test_neighbours_equal_a_naive_search_and_never_look_ahead(bars):
    states = neighbours.study_states(features.positioned(bars, TINY), TINY)
    t = neighbours.targets(states, TINY)
    rows = [r.asDict() for r in states.orderBy("pair", "spos").collect()]
    targets = [r.asDict() for r in t.collect()]
    by_pair: dict = {}
    for r in rows:
        by_pair.setdefault(r["pair"], []).append(r)
    for block in (None, 5):
        for complete in (True, False):
            got: dict = {}
            for r in neighbours.nearest(states, t, TINY, 8, block=block, complete=complete).collect():
                assert r.n_ts < r.ts
                got.setdefault((r.pair, r.spos), {})[r["rank"]] = r.n_spos
            assert len(got) == len(targets)
            for target in targets:
                history = by_pair[target["pair"]][target["spos"] - 20 : target["spos"]]
                dist = lambda h: (sum(((target[f] - h[f]) / target[f"std_{f}"]) ** 2 for f in features.DISTANCE_FEATURES) / 9) ** 0.5
                best = sorted(history, key=dist)[:8]
                found = got[(target["pair"], target["spos"])]
                assert [found[i] for i in range(1, 9)] == [h["spos"] for h in best]


def test_rolling_scaler_equals_direct_deviation(bars):
    import statistics

    states = neighbours.study_states(features.positioned(bars, TINY), TINY)
    rows = {(r.pair, r.spos): r for r in states.collect()}
    checked = 0
    for r in features.rolling_scaler(states, ["pair"], "spos", ["atr", "spread"], 20, 16).collect():
        for f in ("atr", "spread"):
            xs = [rows[(r.pair, p)][f] for p in range(r.spos - 20, r.spos)]
            assert r[f"mean_{f}"] == pytest.approx(statistics.mean(xs), abs=1e-12)
            assert r[f"std_{f}"] == pytest.approx(statistics.stdev(xs), rel=1e-6)
            checked += 1
    assert checked


def test_pruned_scan_equals_sorting_all_and_judges_few():
    import numpy as np

    rng = np.random.default_rng(3)
    states = rng.integers(-30, 30, size=(4000, 3)) / 10.0  # many ties
    order = np.argsort(states[:, 0], kind="stable")
    values, positions = np.ascontiguousarray(states[order].T), order.astype(np.int64)
    weight = np.array([1.0, 0.05, 0.02])
    judged = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            judged.append(np.size(at))
            return super().__getitem__(at)

    for i in range(60):
        target, low, high = rng.integers(-30, 30, size=3) / 10.0, 500, 3500
        counted = [v.view(Counted) for v in values]
        judged.clear()
        rows, distances = neighbours.closest(target, weight, 0, values[0], counted, positions, low, high, 15, True)
        inside = np.arange(low, high)
        d = np.zeros(len(inside))
        for f in range(3):
            gap = target[f] - states[inside, f]
            d += gap * gap * weight[f]
        d = np.sqrt(d)
        best = np.lexsort((inside, d))[:15]
        assert positions[rows].tolist() == inside[best].tolist() and distances.tolist() == d[best].tolist()
        assert judged[0] < 3000  # the first step is enough, or nearly
    # nulls: only the features on both sides count, none at all is infinitely far
    holes = np.where(rng.random(values.shape) < 0.3, np.nan, values)
    rows, distances = neighbours.closest(np.array([0.1, np.nan, 0.3]), np.ones(3), 0, values[0], holes, positions, 0, 4000, 4000, False)
    assert len(rows) == 4000 and np.isinf(distances[-1]) and (np.diff(distances[np.isfinite(distances)]) >= 0).all()
