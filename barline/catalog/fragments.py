"""SQL building blocks (DuckDB dialect) of the equivalence checks."""

from __future__ import annotations

from barline.catalog.registry import DEFAULT, fragment
from barline.operators.features import DISTANCE_FEATURES

S = DEFAULT
L, H, K, MAXH = S.lookback, S.history, S.neighbours, S.max_horizon
HORIZONS = S.horizons

HOUR = 3600
for _tag, _seconds in (("", S.interval_s), ("h", HOUR)):
    fragment(f"x_{_tag}ticks", f"""
SELECT upper(event_type) || CASE WHEN event_type IN ('purchase','signup') THEN '/JPY' ELSE '/USD' END AS pair,
  CAST(ts AS TIMESTAMP) AS tick_ts, event_id,
  CASE WHEN event_type IN ('purchase','signup') THEN 100 + value / 100::DOUBLE ELSE 1 + value / 10000::DOUBLE END AS price,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  to_timestamp(0)::TIMESTAMP + to_seconds(CAST(epoch_us(ts) // 1000000 // {_seconds} * {_seconds} AS BIGINT)) AS ts
FROM events WHERE value > 0""")
    fragment(f"x_{_tag}bid", f"""
SELECT pair, ts, first(price ORDER BY tick_ts, event_id) AS bid_open, max(price) AS bid_high, min(price) AS bid_low,
  last(price ORDER BY tick_ts, event_id) AS bid_close, count(*) AS volume,
  CAST(1 + last(k ORDER BY tick_ts, event_id) % 10 AS DOUBLE) / CASE WHEN pair LIKE '%/JPY' THEN 1000::DOUBLE ELSE 100000::DOUBLE END AS s
FROM x_{_tag}ticks GROUP BY pair, ts""")
    fragment(f"x_{_tag}bars", f"""
SELECT pair, ts, bid_open, bid_high, bid_low, bid_close, bid_open + s AS ask_open, bid_high + s AS ask_high,
  bid_low + s AS ask_low, bid_close + s AS ask_close, volume,
  row_number() OVER (PARTITION BY pair ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY pair) AS bars
FROM x_{_tag}bid""")

fragment("x_sided", """
SELECT pair, '1hour' AS timeframe, 'B' AS offer_side, ts, bid_open AS open, bid_high AS high, bid_low AS low,
  bid_close AS close, volume FROM x_hbars
UNION ALL
SELECT pair, '1hour', 'A', ts, ask_open, ask_high, ask_low, ask_close, volume FROM x_hbars""")

fragment("x_feat", f"""
SELECT *, CASE WHEN bid_close >= mean_close THEN 1.0 ELSE -1.0 END AS trend,
  least(1.0, abs(bid_close - c_first) / (atr * {L} + 1e-12)) AS trend_strength,
  coalesce((bid_close - c5) / nullif(c5, 0), 0) AS momentum,
  coalesce(atr / nullif(mean_close, 0), 0) AS volatility,
  bid_close - hi AS distance_high, bid_close - lo AS distance_low, ask_close - bid_close AS spread,
  CASE WHEN bid_close > hi THEN 1.0 WHEN bid_close < lo THEN -1.0 ELSE 0.0 END AS breakout
FROM (SELECT *, avg(bid_close) OVER f AS mean_close, avg(bid_high - bid_low) OVER f AS atr,
    max(bid_close) OVER f - min(bid_close) OVER f AS range,
    lag(bid_close, 5) OVER o AS c5, lag(bid_close, {L}) OVER o AS c_first,
    max(bid_close) OVER p AS hi, min(bid_close) OVER p AS lo
  FROM x_bars
  WINDOW o AS (PARTITION BY pair ORDER BY ts),
    f AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN {L} PRECEDING AND CURRENT ROW),
    p AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN {L} PRECEDING AND 1 PRECEDING))
WHERE pos >= {L}""")

fragment("x_out", " UNION ALL ".join(f"""
SELECT pair, ts, pos, bars, {h} AS horizon, 'long' AS direction, ask_close AS entry, xb AS exit, xb - ask_close AS move,
  tb - ask_close AS mfe, ask_close - lb AS mae FROM x_fw{h} WHERE xb IS NOT NULL
UNION ALL
SELECT pair, ts, pos, bars, {h}, 'short', bid_close, xa, bid_close - xa, bid_close - la, ta - bid_close FROM x_fw{h} WHERE xb IS NOT NULL"""
    for h in HORIZONS))
for h in HORIZONS:
    fragment(f"x_fw{h}", f"""
SELECT *, last(bid_close) OVER w AS xb, last(ask_close) OVER w AS xa, max(bid_high) OVER w AS tb, min(bid_low) OVER w AS lb,
  max(ask_high) OVER w AS ta, min(ask_low) OVER w AS la, lead(ts, {h}) OVER (PARTITION BY pair ORDER BY ts) AS end_ts
FROM x_bars WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)""")

fragment("x_steps", f"""
SELECT pair, ts, pos, bars, sum(CAST(step <> {S.interval_s} AS INT)) OVER (PARTITION BY pair ORDER BY pos) AS island
FROM (SELECT *, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY pair ORDER BY ts) AS step FROM x_bars)""")

fragment("x_flags", f"""
SELECT pair, ts, pos, bars,
  lag(pos, {L}) OVER o IS NOT NULL AND coalesce(island, 0) = coalesce(lag(island, {L}) OVER o, 0) AS back_ok,
  pos + {MAXH} < bars AND coalesce(island, 0) = coalesce(lead(island, {MAXH}) OVER o, 0) AS ahead_ok
FROM x_steps WINDOW o AS (PARTITION BY pair ORDER BY pos)""")

fragment("x_cs", "SELECT f.*, g.ahead_ok, "
    + ", ".join(f"w{h}.xb - f.ask_close AS long_{h}, f.bid_close - w{h}.xa AS short_{h}, w{h}.end_ts AS end_{h}" for h in HORIZONS)
    + ", row_number() OVER (PARTITION BY f.pair ORDER BY f.ts) - 1 AS spos FROM x_feat f JOIN x_flags g USING (pair, pos) "
    + " ".join(f"JOIN x_fw{h} w{h} ON w{h}.pair = f.pair AND w{h}.pos = f.pos" for h in HORIZONS)
    + " WHERE g.back_ok")

fragment("x_scaled", "SELECT *, " + ", ".join(
    f"avg({f}) OVER w AS mean_{f}, CASE WHEN max({f}) OVER w = min({f}) OVER w THEN 0 ELSE stddev_samp({f}) OVER w END AS std_{f}"
    for f in DISTANCE_FEATURES)
    + f" FROM x_cs WINDOW w AS (PARTITION BY pair ORDER BY spos ROWS BETWEEN {H} PRECEDING AND 1 PRECEDING)")

fragment("x_tgt", f"""
SELECT *, CASE WHEN momentum >= 0 THEN 'long' ELSE 'short' END AS direction,
  CASE WHEN hour(ts) < 7 THEN 'asia' WHEN hour(ts) < 13 THEN 'london' WHEN hour(ts) < 21 THEN 'new_york' ELSE 'rollover' END AS session,
  'regime:' || CASE WHEN breakout > 0 THEN 'breakout_up' WHEN breakout < 0 THEN 'breakout_down'
    WHEN vol_z >= 1 AND trend > 0 AND trend_strength > .5 THEN 'high_vol_trend_up'
    WHEN vol_z >= 1 AND trend < 0 AND trend_strength > .5 THEN 'high_vol_trend_down'
    WHEN vol_z >= 1 THEN 'high_volatility_range'
    WHEN trend_strength >= .5 AND trend > 0 THEN 'trend_up' WHEN trend_strength >= .5 THEN 'trend_down'
    WHEN vol_z <= -1 THEN 'range_low_vol' ELSE 'range_normal' END AS regime
FROM (SELECT *, coalesce((volatility - mean_volatility) / nullif(std_volatility, 0), 0) AS vol_z FROM x_scaled WHERE spos >= {H})""")

_dist = " + ".join(
    f"((t.{f} - h.{f}) / CASE WHEN t.std_{f} = 0 THEN 1 ELSE t.std_{f} END) ** 2" for f in DISTANCE_FEATURES)
_moves = ", ".join(f"h.long_{h} AS n_long_{h}, h.short_{h} AS n_short_{h}" for h in HORIZONS)
fragment("x_nn", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, spos ORDER BY distance, n_spos) AS rank
  FROM (SELECT t.pair, t.spos, t.pos, t.ts, t.ahead_ok, h.spos AS n_spos, h.pos AS n_pos, h.ts AS n_ts, h.ahead_ok AS n_ok,
      sqrt(({_dist}) / {len(DISTANCE_FEATURES)}) AS distance, {_moves}
    FROM x_tgt t JOIN x_cs h ON h.pair = t.pair AND h.spos < t.spos AND h.spos >= t.spos - {H}))
WHERE rank <= {K}""")

fragment("x_near", f"SELECT * FROM x_nn WHERE ahead_ok AND n_ok AND n_pos + {MAXH} < pos")

fragment("x_evid", "SELECT pair, spos, count(*) AS k, median(distance) AS median_distance, "
    "quantile_cont(distance, 0.1) AS distance_p10, quantile_cont(distance, 0.9) AS distance_p90, "
    + ", ".join(f"avg(CAST(n_{d}_{h} > 0 AS INT)) AS agree_{d}_{h}" for h in HORIZONS for d in ("long", "short"))
    + " FROM x_near GROUP BY pair, spos")

fragment("x_rec0", " UNION ALL ".join(f"""
SELECT t.pair, t.ts, year(t.ts) AS year, t.session, t.regime, t.direction, {h} AS horizon, e.k,
  CASE WHEN t.direction = 'long' THEN e.agree_long_{h} ELSE e.agree_short_{h} END AS agreement,
  e.median_distance, e.distance_p10, e.distance_p90,
  CASE WHEN t.direction = 'long' THEN t.long_{h} ELSE t.short_{h} END / CASE WHEN t.pair LIKE '%/JPY' THEN 0.01::DOUBLE ELSE 0.0001::DOUBLE END AS outcome_pips,
  t.end_{h} AS target_end
FROM x_evid e JOIN x_tgt t USING (pair, spos)""" for h in HORIZONS))

fragment("x_paircut", """
SELECT pair, ts AS pair_cut FROM (SELECT pair, ts, row_number() OVER (PARTITION BY pair ORDER BY ts) AS rn,
  count(*) OVER (PARTITION BY pair) AS n FROM (SELECT DISTINCT pair, ts FROM x_rec0))
WHERE rn = CAST(floor(n * 0.6::DOUBLE) AS BIGINT) + 1""")

fragment("x_cut", """
SELECT ts AS cut FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM x_rec0)
WHERE rn = CAST(floor(n * 0.6::DOUBLE) AS BIGINT) + 1""")

fragment("x_rec", f"""
SELECT r.*, CASE WHEN ts >= p.pair_cut THEN 'confirmation' WHEN ts + to_seconds(horizon * {S.interval_s}) < p.pair_cut THEN 'discovery'
    ELSE 'purged_boundary' END AS split,
  CASE WHEN ts >= (SELECT cut FROM x_cut) THEN 'confirmation' WHEN target_end < (SELECT cut FROM x_cut) THEN 'discovery'
    ELSE 'purged_boundary' END AS global_split
FROM x_rec0 r JOIN x_paircut p USING (pair)""")

_KS = S.k_values
fragment("x_two_evid", "SELECT pair, spos, count(*) AS n, " + ", ".join(
    f"avg(CASE WHEN rank <= {k} THEN n_{d}_{h} END) AS m_{d}_{h}_{k}" for h in HORIZONS for k in _KS for d in ("long", "short"))
    + f" FROM x_near WHERE rank <= {max(_KS)} GROUP BY pair, spos HAVING count(*) >= {max(_KS)}")
fragment("x_two0", "SELECT * FROM (" + " UNION ALL ".join(f"""
SELECT t.pair, t.ts, year(t.ts) AS year, t.session, t.regime, {h} AS horizon, {k} AS k,
  CASE WHEN greatest(m_long_{h}_{k}, m_short_{h}_{k}) <= 0 THEN NULL WHEN m_long_{h}_{k} > m_short_{h}_{k} THEN 'long'
    WHEN m_short_{h}_{k} > m_long_{h}_{k} THEN 'short' END AS direction,
  greatest(m_long_{h}_{k}, m_short_{h}_{k}) AS best_mean,
  CASE WHEN m_long_{h}_{k} > m_short_{h}_{k} THEN t.long_{h} ELSE t.short_{h} END / CASE WHEN t.pair LIKE '%/JPY' THEN 0.01::DOUBLE ELSE 0.0001::DOUBLE END AS outcome_pips,
  t.end_{h} AS target_end
FROM x_two_evid e JOIN x_tgt t USING (pair, spos)""" for h in HORIZONS for k in _KS) + ") WHERE direction IS NOT NULL")
fragment("x_two_cut", """
SELECT ts AS cut FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM x_two0)
WHERE rn = CAST(floor(n * 0.6::DOUBLE) AS BIGINT) + 1""")
fragment("x_two", """
SELECT r.*, CASE WHEN ts >= (SELECT cut FROM x_two_cut) THEN 'confirmation' WHEN target_end < (SELECT cut FROM x_two_cut) THEN 'discovery'
    ELSE 'purged_boundary' END AS global_split FROM x_two0 r""")
