"""Context atlas on planted cells."""

from __future__ import annotations

import datetime as dt
import random

from barline.plans import atlas

SHAPE = "pair string, ts timestamp, horizon int, regime string, session string, direction string, agreement double, median_distance double, outcome_pips double, split string, year long"


def weekly(pair: str, values: list[float], split: str = "confirmation") -> list[tuple]:
    start = dt.datetime(2022, 1, 3, 12)
    times = [start + dt.timedelta(days=7 * i) for i in range(len(values))]
    return [(pair, t, 6, "up", "london", "long", 0.75, 0.5, v, split, t.year) for t, v in zip(times, values, strict=True)]


def test_statuses_of_planted_cells(spark):
    rng = random.Random(1)
    rows = weekly("EUR/USD", [1.0 if i < 109 else -0.2 for i in range(120)])
    rows += weekly("GBP/USD", [-0.5] * 30) + weekly("USD/CAD", [-2.0] * 30)
    rows += weekly("USD/JPY", [1.0, -0.5] * 14)  # too few to know
    # a gain that a resample often loses is watched, not strong
    rows += weekly("AUD/USD", [60.0 if i in (10, 60, 110) else -1.0 for i in range(120)])
    rows += weekly("NZD/USD", [rng.uniform(0.5, 1.0) if i % 10 else -1.0 for i in range(120)], "discovery")
    got = {r.pair: r for r in atlas.context_atlas(spark.createDataFrame(rows, SHAPE)).collect()}
    status = {p: r.status for p, r in got.items()}
    assert status == {"EUR/USD": "STRONG_CONTEXT", "GBP/USD": "NO_TRADE", "USD/CAD": "NO_TRADE", "USD/JPY": "UNKNOWN", "AUD/USD": "WATCH_CONTEXT", "NZD/USD": "STRONG_CONTEXT"}
    assert got["EUR/USD"].lower > 0.8 and got["EUR/USD"].upper > got["EUR/USD"].lower and got["AUD/USD"].lower <= 0
    assert got["NZD/USD"].lower is None and got["GBP/USD"].lower is None  # only large confirmation cells are resampled
    assert got["EUR/USD"].median == 1.0 and got["EUR/USD"].max_drawdown > 0
    ranked = atlas.ranked_contexts(spark.createDataFrame(list(got.values()))).collect()
    assert sorted((r.status, r["rank"], r.pair) for r in ranked) == [("NO_TRADE", 1, "USD/CAD"), ("NO_TRADE", 2, "GBP/USD"), ("STRONG_CONTEXT", 1, "EUR/USD"), ("WATCH_CONTEXT", 1, "AUD/USD")]
