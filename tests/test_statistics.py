"""Statistics against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from barline.functions import statistics as st
from barline.operators import evidence as ev
from barline.operators import inference as inf
from barline.operators import paths


def naive_hac(values, lags=5):
    n, m = len(values), sum(values) / len(values)
    c = [v - m for v in values]
    var = sum(x * x for x in c) / n
    for k in range(1, lags + 1):
        var += 2 * (1 - k / (lags + 1)) * sum(c[i] * c[i - k] for i in range(k, n)) / (n - k)
    se = math.sqrt(max(var, 0) / n)
    return (0.0 if m > 0 else 1.0) if se == 0 else 0.5 * math.erfc(m / se / math.sqrt(2))


def test_hac_pvalue(spark):
    rng = random.Random(3)
    groups = {0: [1.0] * 500, 1: [-1.0] * 500, 2: [rng.gauss(0.1, 1) for _ in range(120)], 3: [0.5, -0.2, 0.1, 0.9, 0.3, -0.4, 0.8]}
    rows = [(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    d = spark.createDataFrame(rows, ["g", "i", "v"])
    got = {r.g: r.p_value for r in inf.hac_pvalue(d, ["g"], "v", order=("i",), block=F.floor(F.col("i") / 13)).collect()}
    assert got[0] == 0.0 and got[1] == 1.0
    for g in (2, 3):
        assert got[g] == pytest.approx(naive_hac(groups[g]), abs=3e-7)


def test_multiple_testing(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.5, 0.9]
    d = spark.createDataFrame(list(enumerate(ps)), ["i", "p"])
    got = {r.i: (r.p_bonferroni, r.p_holm, r.p_bh) for r in inf.adjust(d, "p", ["i"]).collect()}
    order, m, run = sorted(range(6), key=ps.__getitem__), 6, 0.0
    holm, bh = {}, {}
    for rank, i in enumerate(order):
        run = max(run, min(1, (m - rank) * ps[i]))
        holm[i] = run
    run = 1.0
    for rank in range(m - 1, -1, -1):
        run = min(run, min(1, ps[order[rank]] * m / (rank + 1)))
        bh[order[rank]] = run
    for i in range(6):
        assert got[i] == pytest.approx((min(1, ps[i] * 6), holm[i], bh[i]))


def test_erfc_is_close(spark):
    d = spark.range(-40, 41).select((F.col("id") / 10.0).alias("x")).withColumn("e", st.erfc(F.col("x")))
    assert max(abs(r.e - math.erfc(r.x)) for r in d.collect()) < 1e-12


def test_calibration_and_drift_literals(spark):
    d = spark.createDataFrame([(0, 0.2, 0), (0, 0.8, 1), (0, 0.7, 1), (0, 0.1, 0)], ["g", "p", "y"])
    r = ev.calibration(ev.calibration_bins(d, ["g"], "p", "y", 4), ["g"]).first()
    assert r.brier == pytest.approx((0.04 + 0.04 + 0.09 + 0.01) / 4) and 0 <= r.ece <= 1 and r.n == 4
    rows = [(0, "reference", v) for v in (0.0, 0.0, 0.1)] + [(0, "current", v) for v in (1.0, 1.0, 1.1)]
    x = ev.drift(spark.createDataFrame(rows, ["g", "w", "v"]), ["g"], "w", "v").first()
    assert x.mean_shift == pytest.approx(1.0) and x.volatility_ratio == pytest.approx(1.0) and x.drift
    c = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], ["a", "b"]).agg(st.pearson("a", "b").alias("r"), st.pearson("a", F.lit(1.0)).alias("z")).first()
    assert c.r == pytest.approx(1.0) and c.z == 0.0


def test_index_folds_and_equal_folds(spark):
    f = paths.index_folds(spark.createDataFrame([(100,), (59,)], ["n"]), "n", 40, 20, 20).collect()
    assert [(r.train_start, r.validation_end) for r in f if r.n == 100] == [(0, 59), (20, 79), (40, 99)]
    assert not [r for r in f if r.n == 59] and all(r.leakage_free for r in f)
    d = spark.range(10).select(F.lit("x").alias("g"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("p").alias("pair"))
    n = {r.fold: r["count"] for r in paths.equal_folds(d, ["g"], 4).groupBy("fold").count().collect()}
    assert n == {0: 2, 1: 2, 2: 2, 3: 4}


def test_resampling_is_reproducible_and_centred(spark):
    rng = random.Random(9)
    vs = [rng.gauss(1, 2) for _ in range(103)]
    d = spark.createDataFrame([("x", i, v) for i, v in enumerate(vs)], ["g", "rn", "v"])
    for make in (lambda s: inf.bootstrap_means(d, ["g"], "v", 400, s), lambda s: inf.block_bootstrap_means(d, ["g"], "v", 5, 400, s)):
        a = sorted(r["mean"] for r in make(1).collect())
        assert a == pytest.approx(sorted(r["mean"] for r in make(1).collect()))
        assert a != sorted(r["mean"] for r in make(2).collect()) and len(a) == 400
        mean = sum(vs) / len(vs)
        sd = math.sqrt(sum((v - mean) ** 2 for v in vs) / len(vs) / len(vs))
        assert abs(sum(a) / 400 - mean) < 0.05
        spread = math.sqrt(sum((x - sum(a) / 400) ** 2 for x in a) / 400)
        assert 0.7 * sd < spread < 1.4 * sd
    lost = spark.createDataFrame([("x", i, -1.0) for i in range(30)] + [("y", i, 1.0) for i in range(30)], ["g", "rn", "v"])
    ruin = {r.g: r.ruin_probability for r in inf.ruin_probability(lost, ["g"], "v", 20.0, 100, 1).collect()}
    assert ruin == {"x": 1.0, "y": 0.0}


def test_logistic_fit_both_ways(spark, monkeypatch):
    rows = [("x", s, int(s > 0.25)) for s in (0.1, 0.2, 0.3, 0.4, 0.5) for _ in range(8)]
    d = spark.createDataFrame(rows, ["g", "s", "y"])
    a = inf.fit_logistic(d, ["g"], "s", "y", steps=5).first()
    monkeypatch.setattr(inf, "SCORES_PER_ROW", 0)
    b = inf.fit_logistic(d, ["g"], "s", "y", steps=5).first()
    assert (a.intercept, a.slope, a.n) == pytest.approx((b.intercept, b.slope, b.n)) and a.slope > 0


def test_grid_cells_equal_matching_every_record(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.4, 0.5, 0.55, 0.62, 0.7, 0.8]), rng.choice([0.3, 0.5, 0.9, 1.5, 1.7, 2.0, 2.4]), rng.uniform(-2, 2), "k") for _ in range(300)]
    d = spark.createDataFrame(rows, ["agreement", "median_distance", "outcome_pips", "key"])
    got = {(r.agreement_min, r.distance_max): (r.n, r.expectancy, r.win_rate) for r in ev.grid_cells(d, ["key"]).collect()}
    assert len(got) == 30
    for (a, c), (n, e, w) in got.items():
        vs = [r[2] for r in rows if r[0] >= a and (c is None or r[1] <= c)]
        assert n == len(vs) and e == pytest.approx(sum(vs) / n) and w == pytest.approx(sum(v > 0 for v in vs) / n)


def test_exact_quantile_with_ties_and_small_groups(spark):
    import statistics

    rng = random.Random(4)
    groups = {0: [rng.gauss(0, 1) for _ in range(501)], 1: [1.0] * 300 + [2.0] * 300 + [rng.random() for _ in range(200)], 2: [3.0], 3: [1.0, 2.0], 4: [5.0, 1.0, 4.0]}
    d = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], ["g", "v"])
    got = {r.g: r.median for r in ev.exact_quantile(d, ["g"], "v").collect()}
    assert got == pytest.approx({g: statistics.median(vs) for g, vs in groups.items()})


def test_erfc_is_exact_in_the_tails(spark):
    xs = [i / 20 for i in range(-120, 400)]
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", st.erfc(F.col("x")).alias("y")).collect()}
    assert max(abs(got[x] / math.erfc(x) - 1) for x in xs) < 1e-12
