"""Bars, features, outcomes, neighbours, records and splits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.catalog.fragments import H, MAXH
from barline.catalog.registry import Tables, query
from barline.functions.labels import pairsets, pip_size
from barline.operators import features, neighbours, outcomes, splits
from barline.operators.features import DISTANCE_FEATURES

STATE = "pair ts:t trend:d trend_strength:d momentum:d volatility:d atr:d range:d distance_high:d distance_low:d spread:d breakout:d"
RECORD = (
    "pair ts:t year:i session regime direction horizon:i k:i agreement:d median_distance:d distance_p10:d "
    "distance_p90:d outcome_pips:d split global_split target_end:t"
)


@query("f1_state_features", STATE, "SELECT * FROM x_feat")
def f1(t: Tables) -> DataFrame:
    return features.states(t.bars(), t.study)


@query(
    "f2_market_state",
    "pair ts:t return_5:d return_20:d range_20:d range_60:d volatility_20:d volatility_60:d trend_20_60:d spread:d session",
    """SELECT pair, ts, bid_close / c5 - 1 AS return_5, bid_close / c20 - 1 AS return_20, r20 AS range_20, r60 AS range_60,
  v20 AS volatility_20, v60 AS volatility_60, (m20 - m60) / m60 AS trend_20_60, ask_close - bid_close AS spread,
  CASE WHEN hour(ts) < 7 THEN 'asia' WHEN hour(ts) < 13 THEN 'london' WHEN hour(ts) < 21 THEN 'new_york' ELSE 'rollover' END AS session
FROM (SELECT *, lag(bid_close, 5) OVER o AS c5, lag(bid_close, 20) OVER o AS c20, avg(bid_close) OVER a AS m20, avg(bid_close) OVER b AS m60,
  max(bid_high) OVER a - min(bid_low) OVER a AS r20, max(bid_high) OVER b - min(bid_low) OVER b AS r60,
  stddev_pop(ret) OVER a AS v20, stddev_pop(ret) OVER b AS v60
 FROM (SELECT *, bid_close / lag(bid_close) OVER (PARTITION BY pair ORDER BY ts) - 1 AS ret FROM x_bars)
 WINDOW o AS (PARTITION BY pair ORDER BY ts), a AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE pos >= 60""",
)
def f2(t: Tables) -> DataFrame:
    return features.market_states(t.bars(), t.study)


@query(
    "f3_one_bar_returns", "pair ts:t ret:d",
    "SELECT * FROM (SELECT pair, ts, bid_close / lag(bid_close) OVER (PARTITION BY pair ORDER BY ts) - 1 AS ret FROM x_bars) WHERE ret IS NOT NULL",
)
def f3(t: Tables) -> DataFrame:
    return features.one_bar_returns(t.bars(), t.study)


@query(
    "f4_rolling_scaler",
    "pair ts:t spos:i " + " ".join(f"mean_{f}:d std_{f}:d" for f in DISTANCE_FEATURES),
    "SELECT pair, ts, spos, " + ", ".join(
        f"mean_{f}, CASE WHEN std_{f} = 0 THEN 1 ELSE std_{f} END AS std_{f}" for f in DISTANCE_FEATURES
    ) + f" FROM x_scaled WHERE spos >= {H}",
)
def f4(t: Tables) -> DataFrame:
    return features.rolling_scaler(t.states(), ["pair"], "spos", DISTANCE_FEATURES, t.study.history, t.study.block_rows)


@query("f5_volatility_z", "pair ts:t vol_z:d", "SELECT pair, ts, vol_z FROM x_tgt")
def f5(t: Tables) -> DataFrame:
    return neighbours.targets(t.states(), t.study)


@query(
    "f6_sampled_targets", "pair ts:t spos:i session regime direction",
    f"SELECT * FROM x_tgt WHERE (spos - {H}) % 5 = 0",
)
def f6(t: Tables) -> DataFrame:
    return neighbours.targets(t.states(), replace(t.study, stride=5))


@query("o1_forward_outcomes", "pair ts:t horizon:i direction entry:d exit:d move:d mfe:d mae:d", "SELECT * FROM x_out")
def o1(t: Tables) -> DataFrame:
    return t.outcomes()


@query(
    "o2_first_touch", "pair ts:t direction hit:b",
    f"""WITH ev AS (SELECT b.pair, b.pos, b.ts, d.direction, f.pos AS fpos,
  CASE WHEN d.direction = 'long' THEN f.bid_high >= b.ask_close + 20 * p.pip ELSE f.ask_low <= b.bid_close - 20 * p.pip END AS won,
  CASE WHEN d.direction = 'long' THEN f.bid_low <= b.ask_close - 10 * p.pip ELSE f.ask_high >= b.bid_close + 10 * p.pip END AS lost
FROM x_bars b CROSS JOIN (VALUES ('long'), ('short')) d(direction) JOIN x_bars f ON f.pair = b.pair AND f.pos > b.pos AND f.pos <= b.pos + {MAXH}
  JOIN (SELECT DISTINCT pair, CASE WHEN pair LIKE '%/JPY' THEN 0.01::DOUBLE ELSE 0.0001::DOUBLE END AS pip FROM x_bars) p ON p.pair = b.pair)
SELECT pair, ts, direction, arg_min(CASE WHEN won AND lost THEN 'both' WHEN won THEN 'won' ELSE 'lost' END, fpos) FILTER (won OR lost) AS w,
 CASE w WHEN 'won' THEN true WHEN 'lost' THEN false END AS hit FROM ev GROUP BY pair, ts, direction""",
)
def o2(t: Tables) -> DataFrame:
    return outcomes.first_touch(t.bars(), t.study, t.study.max_horizon, 20 * pip_size("pair"), 10 * pip_size("pair"))


@query(
    "o3_full_horizon_outcomes", "pair ts:t horizon:i direction entry:d exit:d move:d mfe:d mae:d",
    "SELECT * FROM x_out WHERE pos + horizon < bars",
)
def o3(t: Tables) -> DataFrame:
    return outcomes.outcomes(t.bars(), t.study, full_only=True)


@query(
    "v12_contiguous_windows", "pair ts:t back_ok:b ahead_ok:b",
    "SELECT * FROM x_flags",
)
def v12(t: Tables) -> DataFrame:
    from barline.operators.ordering import in_blocks

    def compute(d: DataFrame, window) -> DataFrame:  # noqa: ANN001
        flags = features.contiguous(window, t.study.interval_s, t.study.lookback, t.study.max_horizon)
        return d.withColumn("_broken", flags.pop("_broken")).withColumns(flags)

    return in_blocks(t.bars(), ["pair"], "pos", t.study.lookback + 1, t.study.max_horizon, compute, t.study.block_rows)


@query(
    "j8_nearest_neighbours", "pair ts:t n_ts:t rank:i distance:d",
    "SELECT * FROM x_nn",
)
def j8(t: Tables) -> DataFrame:
    return neighbours.nearest(t.states(), neighbours.targets(t.states(), t.study), t.study, t.study.neighbours)


@query("j9_eligible_neighbours", "pair ts:t n_ts:t rank:i", "SELECT * FROM x_near")
def j9(t: Tables) -> DataFrame:
    tg = neighbours.targets(t.states(), t.study).filter("ahead_ok")
    return neighbours.eligible(neighbours.nearest(t.states(), tg, t.study, t.study.neighbours), t.study)


@query(
    "j10_neighbour_outcomes", "pair ts:t n_ts:t rank:i " + " ".join(f"n_{d}_{h}:d" for h in (1, 2, 3, 6) for d in ("long", "short")),
    "SELECT * FROM x_near",
)
def j10(t: Tables) -> DataFrame:
    tg = neighbours.targets(t.states(), t.study).filter("ahead_ok")
    near = neighbours.nearest(t.states(), tg, t.study, t.study.neighbours, carry=neighbours.move_names(t.study))
    return neighbours.eligible(near, t.study)


@query("t5_target_records", RECORD, "SELECT * FROM x_rec")
def t5(t: Tables) -> DataFrame:
    return t.records()


@query(
    "t1_global_split", "global_split horizon:i n:i first_ts:t last_ts:t",
    "SELECT global_split, horizon, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM x_rec GROUP BY 1, 2",
)
def t1(t: Tables) -> DataFrame:
    return t.records().groupBy("global_split", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "t2_pair_split", "pair split n:i first_ts:t last_ts:t",
    "SELECT pair, split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM x_rec GROUP BY 1, 2",
)
def t2(t: Tables) -> DataFrame:
    return t.records().groupBy("pair", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "t3_two_sided_direction", "pair ts:t horizon:i k:i direction best_mean:d outcome_pips:d global_split target_end:t",
    "SELECT * FROM x_two",
)
def t3(t: Tables) -> DataFrame:
    return t.two_sided()


@query("t4_momentum_direction", "pair ts:t direction", "SELECT pair, ts, CASE WHEN momentum >= 0 THEN 'long' ELSE 'short' END AS direction FROM x_feat")
def t4(t: Tables) -> DataFrame:
    from barline.functions.labels import momentum_direction

    return features.states(t.bars(), t.study).withColumn("direction", momentum_direction("momentum"))


@query(
    "p17_pairsets", "pairset n:i outcome:d",
    """SELECT pairset, count(*) AS n, sum(outcome_pips) AS outcome FROM (SELECT 'all' AS pairset, outcome_pips FROM x_rec
UNION ALL SELECT 'JPY', outcome_pips FROM x_rec WHERE pair LIKE '%/JPY') GROUP BY 1""",
)
def p17(t: Tables) -> DataFrame:
    r = t.records().select(F.explode(pairsets("pair")).alias("pairset"), "outcome_pips")
    return r.groupBy("pairset").agg(F.count(F.lit(1)).alias("n"), F.sum("outcome_pips").alias("outcome"))


