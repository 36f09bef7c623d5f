"""Input checks and time sets on planted rows."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from barline.operators import evidence as ev
from barline.operators import quality
from barline.plans import paper

START = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return START + dt.timedelta(hours=hours)


def test_sequences_need_order_and_one_identity(spark):
    rows = [("good", at(i), "A/B", "1h", "B") for i in (3, 1, 2)]
    rows += [("tie", at(1), "A/B", "1h", "B"), ("tie", at(1), "A/B", "1h", "B")]
    rows += [("sides", at(1), "A/B", "1h", "B"), ("sides", at(2), "A/B", "1h", "A")]
    rows += [("frames", at(1), "A/B", "1h", "B"), ("frames", at(2), "A/B", "5min", "B")]
    rows += [("pairs", at(1), "A/B", "1h", "B"), ("pairs", at(2), "C/D", "1h", "B"), ("one", at(5), "A/B", "1h", "B")]
    d = spark.createDataFrame(rows, "sequence string, ts timestamp, pair string, timeframe string, offer_side string")
    got = quality.sequence_check(d, ["sequence"], F.unix_seconds("ts"), ["pair", "timeframe", "offer_side"])
    assert {r.sequence: (r.ordered, r.one_identity, r.valid) for r in got.collect()} == {
        "good": (True, True, True), "tie": (False, True, False), "sides": (True, False, False), "frames": (True, False, False), "pairs": (True, False, False), "one": (True, True, True),
    }


def test_closed_orders_are_judged(spark):
    closed = lambda session, order, hour, pnl: (session, order, at(hour), "CLOSED", pnl)
    rows = [closed(1, 1, 1, 2.0), closed(1, 2, 2, -1.0), closed(1, 3, 2, 0.5)]
    rows += [closed(2, 1, 1, 2.0), closed(2, 1, 2, 2.0)]  # one id twice
    rows += [closed(3, 1, 5, 2.0), closed(3, 2, 4, 2.0), closed(3, 200_000, 6, 1.0)]  # earlier than the one before
    rows += [closed(4, 1, 1, None), closed(4, 2, 2, 1.0)]
    rows += [(5, 1, at(1), "FILLED", None)]
    rows += [closed(6, 65_535, 9, 1.0), closed(6, 65_536, 8, 1.0)]  # the break lies between two blocks of ids
    d = spark.createDataFrame(rows, "session_id long, order_id long, ts timestamp, event string, pnl double")
    got = {r.session_id: r for r in paper.session_evaluation(d, -100.0, 1).collect()}
    assert got[1].failures == [] and got[1].passed and got[1].max_drawdown == 1.0
    assert got[2].failures == ["duplicate_closed_order_id"] and not got[2].unique_ids
    assert got[3].failures == ["closed_orders_not_chronological"] == got[6].failures
    assert got[4].failures == ["closed_order_without_pnl"] and not got[4].pnl_present
    assert got[5].failures == ["minimum_closed_trades_not_met", "no_closed_trades"] and got[5].chronological


def test_time_sets_of_all_members(spark):
    rng = random.Random(2)
    sets = {m: {rng.randrange(0, 120_000) for _ in range(n)} for m, n in (("a", 4000), ("b", 4000), ("c", 10))}
    sets["d"] = {500_000}  # meets no other
    sets["e"] = set(sets["a"])
    rows = [(m, at(h)) for m, hours in sets.items() for h in hours] + [("a", at(min(sets["a"])))]
    d = spark.createDataFrame(rows, "pair string, ts timestamp")
    got = {(r.pair_a, r.pair_b): (r.common, r.only_a, r.only_b) for r in ev.time_set_sizes(ev.time_sets(d, "pair", 3600), "pair").collect()}
    assert got == {(a, b): (len(sets[a] & sets[b]), len(sets[a] - sets[b]), len(sets[b] - sets[a])) for a in sets for b in sets if a < b}


def test_correlations_from_co_moments(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = rng.normal(size=(60, 5)) * 1e-4 + np.array([0, 1, 1000, 0, 5.0])
    values[:, 1] += 3 * values[:, 0]
    values[:, 3] = 7.0  # constant
    there = rng.random((60, 5)) < 0.7
    there[:, 4] = False
    there[:2, 4] = True
    rows = [(f"p{m}", at(t), float(values[t, m])) for t in range(60) for m in range(5) if there[t, m]] + [("p0", at(99), None)]
    d = spark.createDataFrame(rows, "pair string, ts timestamp, ret double").repartition(6)
    got = {(r.pair_a, r.pair_b): (r.r, r.n) for r in ev.correlation_matrix(d, ["ts"], "pair", "ret", least=3, constant=None).collect()}
    for a in range(5):
        for b in range(5):
            both = there[:, a] & there[:, b]
            r, n = got.get((f"p{a}", f"p{b}"), (None, 0))
            assert n == both.sum()
            if n < 3 or 3 in (a, b):
                assert r is None
            else:
                assert abs(r - np.corrcoef(values[both, a], values[both, b])[0, 1]) < 1e-6
    assert {r.r for r in ev.correlation_matrix(d, ["ts"], "pair", "ret").collect() if "p3" in (r.pair_a, r.pair_b)} == {0.0}
    assert ev.correlation_matrix(d.limit(0), ["ts"], "pair", "ret").collect() == []
