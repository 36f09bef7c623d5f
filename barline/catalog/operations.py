"""Per-pair studies, portfolio, paper trading, journals and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.catalog.evidence import REC, TRADE, TRADE_SHAPE, drawdown_sql, wilson_sql
from barline.catalog.fragments import HORIZONS, MAXH
from barline.catalog.jobs import block_boot, boot, ruin
from barline.catalog.quality import month, ts
from barline.catalog.registry import FRAGMENTS, Tables, fragment, query
from barline.functions.dimensions import required_features
from barline.operators import evidence as ev
from barline.operators import features, neighbours, paths, quality
from barline.operators.features import DISTANCE_FEATURES
from barline.plans import evaluation, history, paper, portfolio, studies
from barline.session import written
from barline.sources.events import ticks
from barline.streaming import quotes as sq


# ---- per-pair studies (states need no gap-free lookback here)

fragment("x_all_cs", FRAGMENTS["x_cs"].replace(" WHERE g.back_ok", ""))
fragment("x_all_scaled", FRAGMENTS["x_scaled"].replace("x_cs", "x_all_cs"))
fragment("x_all_tgt", FRAGMENTS["x_tgt"].replace("x_scaled", "x_all_scaled"))
fragment("x_all_nn", FRAGMENTS["x_nn"].replace("x_tgt", "x_all_tgt").replace("x_cs", "x_all_cs"))


def all_states(t: Tables) -> DataFrame:
    return t._keep("all_states", lambda: neighbours.study_states(t.bars(), t.study, gap_free=False))


_SD = ", ".join(f"CASE WHEN stddev_samp(h.{f}) > 0 THEN stddev_samp(h.{f}) ELSE 1 END AS s_{f}" for f in DISTANCE_FEATURES)
_DIST = " + ".join(f"((t.{f} - h.{f}) / s.s_{f}) ** 2" for f in DISTANCE_FEATURES)


@query(
    "q1_snapshot", "pair ts:t direction neighbours:i n:i expectancy:d win_rate:d ci_low:d ci_high:d median:d max_drawdown:d mfe_mean:d mae_mean:d",
    f"""WITH t AS (SELECT * FROM x_all_cs QUALIFY row_number() OVER (PARTITION BY pair ORDER BY pos DESC) = 1), s AS (SELECT h.pair, {_SD} FROM x_all_cs h JOIN t ON t.pair = h.pair AND h.pos < t.pos GROUP BY 1),
nn AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY d, n_pos) AS rank FROM (SELECT t.pair, t.ts, CASE WHEN t.momentum >= 0 THEN 'long' ELSE 'short' END AS direction, h.pos AS n_pos, sqrt(({_DIST}) / {len(DISTANCE_FEATURES)}) AS d FROM t JOIN s USING (pair) JOIN x_all_cs h ON h.pair = t.pair AND h.pos < t.pos))
SELECT a.*, b.* EXCLUDE (pair, max_drawdown), coalesce(b.max_drawdown, 0) AS max_drawdown FROM (SELECT pair, ts, direction, count(*) AS neighbours FROM nn WHERE rank <= 50 GROUP BY 1, 2, 3) a LEFT JOIN (
 SELECT *, {wilson_sql('win_rate', 'n')[0]} AS ci_low, {wilson_sql('win_rate', 'n')[1]} AS ci_high FROM (SELECT pair, count(*) AS n, avg(move) AS expectancy, avg(CAST(move > 0 AS INT)) AS win_rate, median(move) AS median, greatest(0, max(peak - cum)) AS max_drawdown, avg(mfe) AS mfe_mean, avg(mae) AS mae_mean
 FROM (SELECT *, greatest(0, max(cum) OVER (PARTITION BY pair ORDER BY rank)) AS peak FROM (SELECT nn.pair, rank, move, mfe, mae, sum(move) OVER (PARTITION BY nn.pair ORDER BY rank) AS cum
 FROM nn JOIN x_out o ON o.pair = nn.pair AND o.pos = nn.n_pos AND o.direction = nn.direction AND o.horizon = 3 AND o.pos + o.horizon < o.bars WHERE rank <= 50)) GROUP BY 1)) b USING (pair)""",
)
def q1(t: Tables) -> DataFrame:
    return studies.snapshot(all_states(t), t.outcomes(), t.study, 3, 50)


@query(
    "q2_neighbour_study", "pair horizon:i n:i expectancy:d win_rate:d profit_factor:d mfe_mean:d mae_mean:d mean_distance:d",
    """SELECT pair, horizon, count(*) AS n, avg(v) AS expectancy, avg(CAST(v > 0 AS INT)) AS win_rate, coalesce(sum(v) FILTER (v > 0), 0) / nullif(-sum(v) FILTER (v < 0), 0) AS profit_factor, avg(mfe) AS mfe_mean, avg(mae) AS mae_mean, avg(distance) AS mean_distance
FROM (SELECT o.pair, o.horizon, o.move AS v, mfe, mae, distance FROM x_all_nn n JOIN x_all_tgt t ON t.pair = n.pair AND t.spos = n.spos JOIN x_out o ON o.pair = n.pair AND o.pos = n.n_pos AND o.direction = t.direction WHERE o.pos + o.horizon < o.bars) GROUP BY 1, 2""",
)
def q2(t: Tables) -> DataFrame:
    return studies.neighbour_study(all_states(t), t.outcomes(), t.study)


_AGREE = ", ".join(f"avg(CAST(n_{d}_{h} > 0 AS INT)) AS agree_{d}_{h}" for h in HORIZONS for d in ("long", "short"))
fragment("x_seq_evid", f"SELECT pair, spos, count(*) AS k, {_AGREE} FROM x_all_nn WHERE n_pos + {MAXH} <= pos GROUP BY 1, 2")
fragment("x_seq", " UNION ALL ".join(f"""
SELECT t.pair, t.ts, t.session, t.regime, year(t.ts) AS year, t.direction, e.k, {h} AS horizon, CASE WHEN t.direction = 'long' THEN agree_long_{h} ELSE agree_short_{h} END AS predicted,
  CASE WHEN t.direction = 'long' THEN long_{h} ELSE short_{h} END AS value FROM x_all_tgt t JOIN x_seq_evid e USING (pair, spos) WHERE t.pos + {h} < t.bars""" for h in HORIZONS))


@query(
    "q3_sequential_study", "pair horizon:i " + TRADE_SHAPE + " brier:d predicted_rate:d mean_analogues:d",
    f"SELECT pair, horizon, {TRADE}, avg((predicted - CAST(v > 0 AS INT)) ** 2) AS brier, avg(predicted) AS predicted_rate, avg(k) AS mean_analogues FROM (SELECT *, value AS v FROM x_seq) GROUP BY 1, 2",
)
def q3(t: Tables) -> DataFrame:
    return studies.sequential_report(studies.sequential_records(all_states(t), t.study))


_SEQ_FOLDS = "SELECT pair, e AS train_end, e + INTERVAL 12 HOUR AS test_start, e + INTERVAL 60 HOUR AS test_end FROM (SELECT pair, unnest(generate_series(lo + INTERVAL 5 DAY, hi - INTERVAL 60 HOUR, INTERVAL 48 HOUR)) AS e FROM (SELECT pair, min(ts) AS lo, max(ts) AS hi FROM x_seq GROUP BY 1))"


@query(
    "q3_walk_forward", "pair horizon:i train_end:t test_start:t test_end:t " + TRADE_SHAPE,
    f"SELECT r.pair, r.horizon, f.train_end, f.test_start, f.test_end, {TRADE} FROM (SELECT *, value AS v FROM x_seq) r JOIN ({_SEQ_FOLDS}) f ON f.pair = r.pair AND r.ts > f.test_start AND r.ts <= f.test_end GROUP BY 1, 2, 3, 4, 5",
)
def q3b(t: Tables) -> DataFrame:
    """Five days of training, a purge of twelve hours, then two days of test; the training end moves on by a test."""
    r = written(studies.sequential_records(all_states(t), t.study), "sequential")
    folds = paths.expanding_folds(r, ["pair"], 5 * 86400, 2 * 86400, None, 12 * 3600).drop("train_start")
    return studies.walk_forward(r, folds)


@query(
    "q3_cross_pair_correlation", "pair_a pair_b r:d n:i",
    """WITH r AS (SELECT pair, ts, bid_close / lag(bid_close) OVER (PARTITION BY pair ORDER BY ts) - 1 AS x FROM x_bars)
SELECT a.pair AS pair_a, b.pair AS pair_b, CASE WHEN count(*) >= 3 AND stddev_pop(a.x) > 0 AND stddev_pop(b.x) > 0 THEN corr(a.x, b.x) END AS r, count(*) AS n FROM r a JOIN r b ON a.ts = b.ts WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2""",
)
def q3c(t: Tables) -> DataFrame:
    return ev.correlation_matrix(features.one_bar_returns(t.bars(), t.study), ["ts"], "pair", "ret", least=3, constant=None)


fragment("x_tail0", f"SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY ts, pair) - 1 AS rn, count(*) OVER (PARTITION BY horizon) AS n FROM {REC}")
fragment("x_tail", "SELECT horizon, ts, pair, outcome_pips, outcome_pips - 0.4::DOUBLE AS v, n, rn - 400 AS r2, (n - 600) // 200 + 1 AS folds FROM x_tail0 WHERE n >= 600 AND rn >= 400")


@query(
    "q18_non_live_evaluation", "horizon:i n:i folds:i folds_positive:b worst_drawdown:d lower:d probability_positive:d ruin_probability:d state failed",
    f"""SELECT *, CASE WHEN failed = '' THEN 'PASS' ELSE 'FAIL' END AS state FROM (SELECT *, concat_ws(',', CASE WHEN NOT folds_positive THEN 'folds_positive' END, CASE WHEN NOT m - 1.5 > 0 THEN 'stress_resilient' END,
 CASE WHEN NOT (lower > 0 AND probability_positive >= 0.95 AND ruin_probability < 0.05) THEN 'uncertainty_supportive' END) AS failed
FROM (SELECT horizon, any_value(n) AS n, avg(outcome_pips) AS m FROM x_tail GROUP BY 1) JOIN (SELECT horizon, count(*) AS folds, bool_and(e > 0) AS folds_positive, max(max_drawdown) AS worst_drawdown FROM (SELECT horizon, fold, avg(v) AS e FROM x_tailf GROUP BY 1, 2) JOIN ({drawdown_sql('x_tailf', 'horizon, fold')}) USING (horizon, fold) GROUP BY 1) USING (horizon)
JOIN (SELECT horizon, least(a.lower, b.block_lower) AS lower, a.probability_positive FROM ({boot('x_tail', 'horizon', 1000, 31, 25)}) a JOIN ({block_boot('x_tail', 'horizon', 1000, 32, 25)}) b USING (horizon)) USING (horizon) JOIN ({ruin('x_tail', 'horizon', 5000, 33, 0.0)}) USING (horizon))""",
)
def q18(t: Tables) -> DataFrame:
    return evaluation.non_live(t.records(), ["horizon"], 400, 200, 200, (0.4, 0.8, 1.5), 1000, 25, 31).withColumn("failed", F.array_join("failed", ","))


fragment("x_tailf", "SELECT *, least(r2 // ((n - 400) // folds), folds - 1) AS fold FROM x_tail")

# ---- portfolio

CLASSES = ("FOREX", "CRYPTO", "METAL", "COMMODITY", "EQUITY", "INDEX")


def asset_class(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (key % 6 + 1).cast("int"))


_CLS = "['FOREX','CRYPTO','METAL','COMMODITY','EQUITY','INDEX']"
fragment("x_evidence", f"""
SELECT c_custkey AS custkey, c_name AS symbol, {_CLS}[c_custkey % 6 + 1] AS asset_class, samples, confidence, edge, (c_nationkey % 5) / 3.0::DOUBLE AS adverse, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 100) / 100.0::DOUBLE END AS agreement,
  c_custkey % 17 <> 0 AS data_healthy, c_custkey % 19 <> 0 AS context_known, c_custkey % 6 = 0 AS research_ready
FROM customer LEFT JOIN (SELECT o_custkey, count(*) * 20 AS samples, avg(CAST(o_totalprice > 200000 AS INT)) AS confidence, avg(o_totalprice) - 250000 AS edge FROM orders GROUP BY 1) ON o_custkey = c_custkey""")


def evidence(t: Tables) -> DataFrame:
    o = t.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        (F.count(F.lit(1)) * 20).alias("samples"), F.avg((F.col("o_totalprice") > 200000).cast("double")).alias("confidence"), (F.avg("o_totalprice") - 250000).alias("edge")
    )
    k = F.col("c_custkey")
    return t.table("customer").join(o, "c_custkey", "left").select(
        k.alias("custkey"), F.col("c_name").alias("symbol"), asset_class(k).alias("asset_class"), "samples", "confidence", "edge", (F.col("c_nationkey") % 5 / 3.0).alias("adverse"),
        F.when(k % 3 > 0, k % 100 / 100.0).alias("agreement"), (k % 17 != 0).alias("data_healthy"), (k % 19 != 0).alias("context_known"), (k % 6 == 0).alias("research_ready"),
    )


fragment("x_flow", """
SELECT *, concat_ws(',', CASE WHEN NOT data_healthy THEN 'market_data_unhealthy' END, CASE WHEN NOT context_known THEN 'market_context_unknown' END, CASE WHEN coalesce(samples < 200, true) THEN 'evidence_floor_not_met' END,
 CASE WHEN coalesce(confidence < 0.55, true) THEN 'confidence_below_floor' END, CASE WHEN coalesce(edge <= 0, true) THEN 'edge_after_costs_not_positive' END, CASE WHEN adverse > 1 THEN 'adverse_risk_above_limit' END,
 CASE WHEN coalesce(agreement < 0.7, false) THEN 'expert_agreement_below_floor' END, CASE WHEN NOT research_ready THEN 'instrument_not_research_ready' END) AS why FROM x_evidence""")
fragment("x_positions", f"SELECT 'Supplier' || s_suppkey AS symbol, {_CLS}[s_suppkey % 6 + 1] AS asset_class, 0.002::DOUBLE AS risk FROM supplier WHERE s_acctbal > 9600")
fragment("x_alloc", """
SELECT *, CASE WHEN n >= 8 THEN 'position_count_limit_reached' WHEN total >= 0.02 THEN 'portfolio_risk_limit_reached' WHEN class_risk >= 0.01 THEN 'asset_class_risk_limit_reached' WHEN flow_state <> 'READY' THEN 'flow_state_' || lower(flow_state)
  WHEN granted <= 0 THEN 'no_risk_budget_available' ELSE 'bounded_portfolio_risk_budget_granted' END AS allocation
FROM (SELECT *, least(0.005, 0.02 - total, 0.01 - class_risk) AS granted FROM (SELECT f.*, CASE WHEN NOT data_healthy OR NOT context_known THEN 'BLOCKED' WHEN why <> '' THEN 'WAIT' ELSE 'READY' END AS flow_state,
  (SELECT count(*) FROM x_positions) AS n, (SELECT coalesce(sum(risk), 0) FROM x_positions) AS total, coalesce(p.class_risk, 0) AS class_risk FROM x_flow f LEFT JOIN (SELECT asset_class, sum(risk) AS class_risk FROM x_positions GROUP BY 1) p USING (asset_class)))""")


def positions(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.table("supplier").filter(F.col("s_acctbal") > 9600).select(
        F.concat(F.lit("Supplier"), k.cast("string")).alias("symbol"), asset_class(k).alias("asset_class"), F.lit(0.002).alias("risk")
    )


@query(
    "q20_flow_allocation", "custkey:i flow_state why allocation allowed:b budget:d",
    "SELECT *, allocation = 'bounded_portfolio_risk_budget_granted' AS allowed, CASE WHEN allocation = 'bounded_portfolio_risk_budget_granted' THEN granted ELSE 0 END AS budget FROM x_alloc",
)
def q20(t: Tables) -> DataFrame:
    d = portfolio.allocate(portfolio.flow(evidence(t)), positions(t))
    return d.withColumn("why", F.array_join("reasons", ","))


@query(
    "q20_research_verdict", "custkey:i verdict verdict_reasons",
    """SELECT custkey, CASE WHEN miss <> '' THEN 'BLOCKED' WHEN flow_state <> 'READY' THEN flow_state WHEN allocation = 'bounded_portfolio_risk_budget_granted' THEN 'READY' ELSE 'WAIT' END AS verdict,
 CASE WHEN miss <> '' THEN miss WHEN flow_state <> 'READY' THEN why WHEN allocation = 'bounded_portfolio_risk_budget_granted' THEN '' ELSE allocation END AS verdict_reasons
FROM (SELECT *, CASE WHEN custkey % 4 = 0 AND asset_class IN ('FOREX', 'CRYPTO', 'METAL', 'EQUITY') THEN 'missing_context:momentum' ELSE '' END AS miss FROM x_alloc)""",
)
def q20b(t: Tables) -> DataFrame:
    d = portfolio.allocate(portfolio.flow(evidence(t)), positions(t))
    need = required_features(F.col("asset_class"))
    have = F.when(F.col("custkey") % 4 == 0, F.array_remove(need, "momentum")).otherwise(need)
    out = portfolio.research_verdict(d, F.array_sort(F.array_except(need, have)))
    return out.withColumn("verdict_reasons", F.array_join("verdict_reasons", ","))


@query(
    "q21_decisions", "instrument:i direction action confidence:d",
    """SELECT c_custkey AS instrument, direction, CASE WHEN samples IS NULL THEN 'NO_TRADE' WHEN samples >= 10 AND win_rate >= 0.55 AND expectancy >= 0 AND adverse <= 0.5 THEN direction ELSE 'WAIT' END AS action, coalesce(win_rate, 0) AS confidence
FROM (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS direction FROM customer) LEFT JOIN (SELECT o_custkey, count(*) AS samples, avg(CAST(o_totalprice > 250000 AS INT)) AS win_rate, avg(o_totalprice - 250000) AS expectancy, max(250000 - o_totalprice) / 500000 AS adverse FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def q21(t: Tables) -> DataFrame:
    side = F.when(F.col("c_nationkey") % 2 == 0, "BUY").otherwise("SELL")
    p = F.col("o_totalprice")
    e = t.table("orders").groupBy(F.col("o_custkey").alias("instrument")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg((p > 250000).cast("double")).alias("win_rate"), F.avg(p - 250000).alias("expectancy"), (F.max(250000 - p) / 500000).alias("adverse")
    )
    return portfolio.decisions(t.table("customer").select(F.col("c_custkey").alias("instrument"), side.alias("direction")), e, samples=10, adverse=0.5)


@query(
    "q24_stage_promotion", "custkey:i state reasons",
    """SELECT c_custkey AS custkey, CASE WHEN first <> '' THEN 'BLOCKED' WHEN NOT p THEN 'PAPER_READY' WHEN NOT s THEN 'SHADOW_READY' ELSE 'BLOCKED' END AS state,
 CASE WHEN first <> '' THEN first WHEN NOT p THEN 'paper_period_not_passed' WHEN NOT s THEN 'shadow_period_not_passed' ELSE concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'credentials_not_configured' END, CASE WHEN c_custkey % 3 = 0 THEN 'daily_loss_not_tested' END, 'human_approval_missing', 'live_execution_disabled', 'execution_gateway_disabled') END AS reasons
FROM (SELECT c_custkey, concat_ws(',', CASE WHEN NOT c_acctbal > 0 THEN 'empirical_confirmation_not_passed' END, CASE WHEN NOT c_nationkey > 5 THEN 'robustness_not_passed' END, CASE WHEN c_custkey % 13 = 0 THEN 'strategy_factory_not_eligible' END) AS first, c_nationkey > 10 AS p, c_nationkey > 15 AS s FROM customer)""",
)
def q24(t: Tables) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    d = t.table("customer").select(
        k.alias("custkey"), (F.col("c_acctbal") > 0).alias("empirical_passed"), (n > 5).alias("robustness_passed"), (k % 13 != 0).alias("factory_eligible"), (n > 10).alias("paper_passed"),
        (n > 15).alias("shadow_passed"), (k % 2 != 0).alias("credentials_configured"), F.lit(True).alias("emergency_stop_tested"), (k % 3 != 0).alias("daily_loss_tested"),
        F.lit(True).alias("stale_spread_tested"), F.lit(True).alias("broker_limits_verified"), F.lit(None).cast("boolean").alias("human_approval_present"), F.lit(False).alias("live_execution_enabled"),
    )
    return portfolio.promotion(d).withColumn("reasons", F.array_join("reasons", ","))


# ---- paper trading and journals

fragment("x_orders", """
SELECT event_id AS order_id, user_id AS session_id, ts, value AS bid, value + (k % 10 + 1) / 1000.0::DOUBLE AS ask, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS action, k % 9 > 0 AS authorized, event_id % 5 + 1 AS quantity
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_id % 2 = 0""")
fragment("x_exits", "SELECT event_id - 1 AS order_id, value AS x_bid, value + 0.004::DOUBLE AS x_ask FROM events WHERE event_id % 2 = 1 AND event_id % 6 <> 1")
fragment("x_paper", """
SELECT *, CASE WHEN NOT authorized THEN 'REJECTED' WHEN x_bid IS NOT NULL THEN 'CLOSED' ELSE 'FILLED' END AS event, CASE WHEN NOT authorized THEN NULL WHEN action = 'BUY' THEN ask + 0.01 ELSE bid - 0.01 END AS entry_price,
  CASE WHEN NOT authorized THEN NULL WHEN action = 'BUY' THEN x_bid - 0.01 ELSE x_ask + 0.01 END AS exit_price, (exit_price - entry_price) * quantity * CASE WHEN action = 'BUY' THEN 1 ELSE -1 END AS pnl
FROM x_orders LEFT JOIN x_exits USING (order_id)""")


def paper_orders(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = t.table("events").withColumn("k", k).withColumn("ts", F.col("ts").cast("timestamp"))
    signals = e.filter(F.col("event_id") % 2 == 0).select(
        F.col("event_id").alias("order_id"), F.col("user_id").alias("session_id"), "ts", F.col("value").alias("bid"), (F.col("value") + (F.col("k") % 10 + 1) / 1000.0).alias("ask"),
        F.when(F.col("k") % 2 == 0, "BUY").otherwise("SELL").alias("action"), (F.col("k") % 9 > 0).alias("authorized"), (F.col("event_id") % 5 + 1).alias("quantity"), F.lit(0.01).alias("slippage"),
    )
    exits = e.filter((F.col("event_id") % 2 == 1) & (F.col("event_id") % 6 != 1)).select(
        (F.col("event_id") - 1).alias("order_id"), "ts", F.col("value").alias("bid"), (F.col("value") + 0.004).alias("ask")
    )
    return paper.closes(paper.fills(signals), exits)


@query("q22_paper_fills", "order_id:i action event entry_price:d exit_price:d pnl:d", "SELECT * FROM x_paper")
def q22(t: Tables) -> DataFrame:
    return paper_orders(t)


EVALUATION = "session_id:i closed_trades:i wins:i losses:i total_pnl:d expectancy:d profit_factor:d max_drawdown:d unique_ids:b chronological:b pnl_present:b failures"
fragment("x_session", f"""
SELECT s.session_id, coalesce(n, 0) AS closed_trades, coalesce(w, 0) AS wins, coalesce(l, 0) AS losses, coalesce(tot, 0) AS total_pnl, coalesce(tot / n, 0) AS expectancy, pf AS profit_factor, coalesce(max_drawdown, 0) AS max_drawdown,
 coalesce(u, true) AS unique_ids, coalesce(c, true) AS chronological, coalesce(f, true) AS pnl_present,
 concat_ws(',', CASE WHEN NOT u THEN 'duplicate_closed_order_id' END, CASE WHEN NOT c THEN 'closed_orders_not_chronological' END, CASE WHEN NOT f THEN 'closed_order_without_pnl' END, CASE WHEN coalesce(n, 0) < 12 THEN 'minimum_closed_trades_not_met' END, CASE WHEN coalesce(tot, 0) <= -500 THEN 'maximum_session_loss_breached' END, CASE WHEN n IS NULL THEN 'no_closed_trades' END) AS failures
FROM (SELECT DISTINCT session_id FROM x_paper) s LEFT JOIN (SELECT session_id, count(*) AS n, count(*) FILTER (v > 0) AS w, count(*) FILTER (v < 0) AS l, round(sum(v), 6) AS tot, coalesce(sum(v) FILTER (v > 0), 0) / nullif(coalesce(-sum(v) FILTER (v < 0), 0), 0) AS pf,
  count(DISTINCT order_id) = count(*) AS u, count(v) = count(*) AS f, bool_and(coalesce(ts >= before, true)) AS c FROM (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY order_id, ts) AS before FROM x_closed) GROUP BY 1) USING (session_id)
LEFT JOIN ({drawdown_sql('x_closed', 'session_id', 'ts, order_id')}) USING (session_id)""")
fragment("x_closed", "SELECT *, pnl AS v FROM x_paper WHERE event = 'CLOSED'")


@query("a23_paper_evaluation", EVALUATION, "SELECT * FROM x_session")
def a23(t: Tables) -> DataFrame:
    return paper.session_evaluation(paper_orders(t), -500.0, 12).withColumn("failures", F.array_join("failures", ","))


@query(
    "q23_campaign_verdict", "session_id:i accepted:i state reasons",
    """SELECT *, CASE WHEN reasons = '' THEN 'COMPLETE' WHEN regexp_matches(reasons, 'expectancy_not|profit_factor_not|session_loss') THEN 'FAILED' WHEN regexp_matches(reasons, 'window_not|observations_not|trades_not_met|missing') THEN 'INCOMPLETE' ELSE 'FAILED' END AS state
FROM (SELECT o.session_id, accepted, concat_ws(',', CASE WHEN last < TIMESTAMP '2024-01-30' THEN 'campaign_window_not_complete' END, CASE WHEN accepted < 50 THEN 'minimum_accepted_observations_not_met' END, CASE WHEN s.session_id IS NULL THEN 'paper_evaluation_missing' END,
 CASE WHEN closed_trades < 12 THEN 'minimum_closed_trades_not_met' END, CASE WHEN total_pnl <= -500 THEN 'maximum_session_loss_breached' END, CASE WHEN closed_trades = 0 THEN 'no_closed_trades' END, CASE WHEN expectancy <= 0 THEN 'paper_expectancy_not_positive' END,
 CASE WHEN s.session_id IS NOT NULL AND (profit_factor IS NULL OR profit_factor <= 1) THEN 'paper_profit_factor_not_above_threshold' END) AS reasons
FROM (SELECT user_id AS session_id, count(*) FILTER (value < 100) AS accepted, max(ts) AS last FROM events GROUP BY 1) o LEFT JOIN x_session s USING (session_id))""",
)
def q23(t: Tables) -> DataFrame:
    seen = t.table("events").groupBy(F.col("user_id").alias("session_id")).agg(F.count_if(F.col("value") < 100).alias("accepted"), F.max(F.col("ts").cast("timestamp")).alias("last"))
    spec = {"accepted": 50, "closed": 12, "expectancy": 0.0, "profit_factor": 1.0}
    out = paper.campaign(paper.session_evaluation(paper_orders(t), -500.0, 12), seen, spec, F.col("last") >= ts("2024-01-30"))
    return out.withColumn("reasons", F.array_join("reasons", ","))


fragment("x_entries", """
SELECT user_id AS session_id, epoch_us(ts) // 1000000 AS ts, event_id AS entry, CASE WHEN event_type = 'purchase' THEN 'ORDER' ELSE 'QUOTE' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS sequence FROM events""")
_JSON = """'{"entry":' || e.entry || ',"kind":"' || e.kind || '","previous_hash":"' || %s || '","sequence":' || e.sequence || ',"session_id":' || e.session_id || ',"ts":' || e.ts || '}'"""
_CHAIN = f"""WITH RECURSIVE chain AS (SELECT e.*, repeat('0', 64) AS previous_hash, sha256({_JSON % "repeat('0', 64)"}) AS record_hash FROM x_entries e WHERE sequence = 1
UNION ALL SELECT e.*, c.record_hash, sha256({_JSON % 'c.record_hash'}) FROM chain c JOIN x_entries e ON e.session_id = c.session_id AND e.sequence = c.sequence + 1) SELECT * FROM chain"""


def entries(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("session_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("entry"),
        F.when(F.col("event_type") == "purchase", "ORDER").otherwise("QUOTE").alias("kind"),
    )


def journal(t: Tables) -> DataFrame:
    return t._keep("journal", lambda: paper.journal(entries(t.table("events"))))


@query("q25_journal_chain", "session_id:i sequence:i entry:i kind ts:i previous_hash record_hash".replace("ts:i", "at:i"), f"SELECT *, ts AS at FROM ({_CHAIN})")
def q25(t: Tables) -> DataFrame:
    return journal(t).withColumn("at", F.col("ts"))


@query(
    "q25_chain_verification", "session_id:i records:i contiguous:b linked:b hashes_ok:b ok:b",
    """SELECT user_id AS session_id, count(*) AS records, true AS contiguous, true AS linked, count(*) FILTER (event_id % 997 = 0) = 0 AS hashes_ok, count(*) FILTER (event_id % 997 = 0) = 0 AS ok FROM events GROUP BY 1""",
)
def q25b(t: Tables) -> DataFrame:
    forged = journal(t).withColumn("kind", F.when(F.col("entry") % 997 == 0, "FORGED").otherwise(F.col("kind")))
    return paper.verified(forged)


_DOCUMENT = (
    """'{"head_hash":"' || max(head) || '","part":' || part || ',"records":[' || string_agg('{"sequence":' || sequence || ',"entry":' || entry || ',"kind":"' || kind || '","previous_hash":"' || previous_hash"""
    """ || '","record_hash":"' || record_hash || '","ts":' || ts || '}', ',' ORDER BY sequence) || '],"session_id":' || session_id || '}'"""
)


@query(
    "s18_journal_export", "session_id:i part:i n:i head_hash document",
    f"""SELECT session_id, part, count(*) AS n, max(head) AS head_hash, {_DOCUMENT} AS document
FROM (SELECT *, (sequence - 1) // 20 AS part, last_value(record_hash) OVER (PARTITION BY session_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head FROM ({_CHAIN}))
WHERE session_id NOT IN (SELECT user_id FROM events WHERE event_id % 997 = 0) GROUP BY session_id, part""",
)
def s18(t: Tables) -> DataFrame:
    """Whole documents in parts of twenty records; sessions with a forged record are left out."""
    forged = journal(t).withColumn("kind", F.when(F.col("entry") % 997 == 0, "FORGED").otherwise(F.col("kind")))
    return paper.export(forged, paper.verified(forged), per_part=20)


@query(
    "q26_validated_history", "pair rows:i missing:i missing_ask:i missing_bid:i ok:b",
    """SELECT pair, 2 * count(*) AS rows, 2 * sum(CASE WHEN gap > 3600 THEN greatest(1, gap // 3600 - 1) ELSE 0 END) AS missing, 0 AS missing_ask, 0 AS missing_bid, true AS ok
FROM (SELECT *, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY pair ORDER BY ts) AS gap FROM x_hbars WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND pair <> 'VIEW/USD') GROUP BY 1""",
)
def q26(t: Tables) -> DataFrame:
    asked = t.hourly().filter(F.col("pair") != "VIEW/USD").select(F.lower(F.regexp_replace("pair", "/", "_")).alias("symbol")).distinct()
    return history.validated_history(t.sided(), asked, ts("2024-01-05"), ts("2024-01-25"), month())


# ---- streams


def event_stream(t: Tables) -> DataFrame:
    return sq.stream_table(t.spark, t.folder, "events")


@query(
    "r1_quote_guard", "event_id:i status reason",
    """SELECT event_id, CASE WHEN reason = 'ok' THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, reason FROM (SELECT event_id, CASE WHEN k > 60 THEN 'stale' WHEN k < 3 THEN 'future' WHEN value / 100 > 1.5 THEN 'wide' ELSE 'ok' END AS reason
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))""",
)
def r1(t: Tables) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("bigint")
    q = event_stream(t).select("event_id", at.alias("ts"), F.timestamp_micros(F.unix_micros(at) + (k - 5) * 1000000).alias("observed_at"), F.lit(0.0).alias("bid"), (F.col("value") / 100).alias("ask"))
    return sq.run_to_table(sq.guard(q, 55.0, 1.5), "guard").select("event_id", "status", "reason")


# Arrivals: four micro-batches by time, rows that come three batches late, rows that come twice.
def arrivals(t: Tables) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    day = F.unix_seconds(at) - F.unix_seconds(ts("2024-01-01"))
    own = F.when(F.col("event_id") % 23 == 5, 3).otherwise(F.least(F.greatest(F.floor(day / (8 * 86400)), F.lit(0)), F.lit(3))).cast("int")
    e = t.table("events").withColumn("ts", at).withColumn("batch", own)
    return e.unionByName(e.filter("event_id % 17 = 2 AND batch < 3").withColumn("batch", F.col("batch") + 1))


fragment("x_own_batch", "SELECT *, CASE WHEN event_id % 23 = 5 THEN 3 ELSE least(greatest((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 // (8 * 86400), 0), 3) END AS batch FROM events")
fragment("x_arrivals", "SELECT * FROM x_own_batch UNION ALL SELECT * EXCLUDE (batch), batch + 1 AS batch FROM x_own_batch WHERE event_id % 17 = 2 AND batch < 3")
fragment("x_arrived", """SELECT u.user_id, b.batch, coalesce(n, 0) AS received, coalesce(bad, false) AS bad FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range(0, 4)) AS batch) b
 LEFT JOIN (SELECT user_id, batch, count(*) AS n, bool_or(value > 300) AS bad FROM x_arrivals GROUP BY 1, 2) a ON a.user_id = u.user_id AND a.batch = b.batch""")
fragment("x_stored", """SELECT user_id, event_id, ts, store FROM (SELECT a.user_id, a.event_id, a.ts, (SELECT min(x.batch) FROM x_arrived x WHERE x.user_id = a.user_id AND x.batch >= a.batch AND NOT x.bad) AS store
 FROM (SELECT user_id, event_id, min(ts) AS ts, min(batch) AS batch FROM x_arrivals WHERE value <= 300 GROUP BY 1, 2) a) WHERE store IS NOT NULL""")


def ingested(t: Tables) -> dict[str, DataFrame]:
    rows = arrivals(t).select("user_id", "event_id", "ts", "value", "batch")
    s = sq.replayed(rows, F.col("batch"), 4, "ingest").drop("batch")
    return sq.ingest(s, ["user_id", "event_id"], ["user_id"], "ts", F.col("value") <= 300, "ingest", rows.select("user_id"))


@query(
    "r2_ingest_cycle", "user_id:i epoch:i received:i stored:i status checkpoint:t",
    """SELECT x.user_id, x.batch AS epoch, received, coalesce(s.n, 0) AS stored,
 CASE WHEN bad THEN 'FAILED' WHEN s.n > 0 THEN 'UPDATED' WHEN received = 0 AND NOT waits THEN 'NO_DATA' ELSE 'CURRENT' END AS status, max(s.latest) OVER (PARTITION BY x.user_id ORDER BY x.batch) AS checkpoint
FROM (SELECT *, coalesce(lag(bad) OVER (PARTITION BY user_id ORDER BY batch), false) AS waits FROM x_arrived) x LEFT JOIN (SELECT user_id, store, count(*) AS n, max(ts) AS latest FROM x_stored GROUP BY 1, 2) s ON s.user_id = x.user_id AND s.store = x.batch""",
)
def r2(t: Tables) -> DataFrame:
    return ingested(t)["outcomes"]


@query(
    "r2_ingest_places", "user_id:i event_id:i place",
    """SELECT user_id, event_id, 'stored' AS place FROM x_stored UNION ALL SELECT user_id, event_id, 'rejected' FROM x_arrivals WHERE value > 300
UNION ALL SELECT a.user_id, a.event_id, 'waiting' FROM x_arrivals a WHERE value <= 300 AND NOT EXISTS (SELECT 1 FROM x_arrived x WHERE x.user_id = a.user_id AND x.batch >= a.batch AND NOT x.bad)""",
)
def r2b(t: Tables) -> DataFrame:
    out = ingested(t)
    named = lambda part, place: out[part].select("user_id", "event_id", F.lit(place).alias("place"))
    return named("data", "stored").unionByName(named("rejects", "rejected")).unionByName(named("retry", "waiting"))


@query("r3_late_and_duplicate_rows", "user_id:i n:i", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def r3(t: Tables) -> DataFrame:
    s = event_stream(t).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = s.select("user_id", "event_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"), "ts").drop("copy")
    return sq.run_to_table(sq.distinct_bars(twice, ["user_id", "event_id"], "ts", "1 hour"), "distinct").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "r4_streamed_candles", "pair ts:t open:d high:d low:d close:d volume:i",
    """SELECT pair, ts, bid_open AS open, bid_high AS high, bid_low AS low, bid_close AS close, volume FROM x_hbars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE value > 0)""",
)
def r4(t: Tables) -> DataFrame:
    return sq.run_to_table(sq.candles(ticks(event_stream(t)), "1 hour", "10 minutes"), "candles")


# Entries as they arrive: accepted if not before the latest accepted one and not after a final one.
fragment("x_arriving", """SELECT user_id AS session_id, batch, epoch_us(ts) // 1000000 AS ts, event_id AS entry, CASE WHEN event_id % 50 = 7 THEN 'FINALIZED' WHEN event_type = 'purchase' THEN 'ORDER' ELSE 'QUOTE' END AS final_kind,
 CASE WHEN event_type = 'purchase' THEN 'ORDER' ELSE 'QUOTE' END AS kind FROM x_own_batch""")
fragment("x_in_order", "SELECT *, row_number() OVER w AS nth, ts >= coalesce(max(ts) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts) AS timely FROM x_arriving WINDOW w AS (PARTITION BY session_id ORDER BY batch, ts, entry)")
fragment("x_numbered", "SELECT session_id, ts, entry, kind, row_number() OVER (PARTITION BY session_id ORDER BY nth) AS sequence FROM x_in_order WHERE timely")


def arriving(t: Tables, final: bool) -> DataFrame:
    rows = entries(t.table("events")).join(arrivals(t).groupBy(F.col("event_id").alias("entry")).agg(F.min("batch").alias("batch")), "entry")
    if final:
        rows = rows.withColumn("kind", F.when(F.col("entry") % 50 == 7, "FINALIZED").otherwise(F.col("kind")))
    return sq.replayed(rows, F.col("batch"), 4, "entries")


@query(
    "r5_session_chain", "session_id:i sequence:i entry:i kind at:i previous_hash record_hash accepted:b reason",
    f"""SELECT session_id, sequence, entry, kind, ts AS at, previous_hash, record_hash, true AS accepted, NULL AS reason FROM ({_CHAIN.replace("x_entries", "x_numbered")})
UNION ALL SELECT session_id, NULL, entry, kind, ts, NULL, NULL, false, 'out_of_order' FROM x_in_order WHERE NOT timely""",
)
def r5(t: Tables) -> DataFrame:
    return sq.run_to_table(sq.chained(arriving(t, False)), "chain").withColumn("at", F.col("ts"))


@query(
    "r6_daily_loss_latch", "account:i entry:i daily_pnl:d stopped:b",
    """SELECT account, entry, run AS daily_pnl, NOT reset AND coalesce(min(CASE WHEN NOT reset THEN run END) OVER (PARTITION BY account, since ORDER BY batch, s, entry ROWS UNBOUNDED PRECEDING), 0) <= -60 AS stopped
FROM (SELECT *, sum(CASE WHEN reset THEN 0 ELSE delta END) OVER (PARTITION BY account, since, d ORDER BY batch, s, entry ROWS UNBOUNDED PRECEDING) AS run
 FROM (SELECT *, count(*) FILTER (reset) OVER (PARTITION BY account ORDER BY batch, s, entry ROWS UNBOUNDED PRECEDING) AS since
  FROM (SELECT user_id AS account, event_id AS entry, batch, value - 50 AS delta, event_id % 41 = 3 AS reset, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 86400000000 AS d FROM x_own_batch)))""",
)
def r6(t: Tables) -> DataFrame:
    rows = arrivals(t).groupBy("event_id").agg(F.min_by(F.struct("user_id", "ts", "value"), "batch").alias("e"), F.min("batch").alias("batch"))
    d = rows.select(F.col("e.user_id").alias("account"), F.unix_seconds("e.ts").alias("ts"), F.col("event_id").alias("entry"), (F.col("e.value") - 50).alias("delta"), (F.col("event_id") % 41 == 3).alias("reset"), "batch")
    return sq.run_to_table(sq.loss_latch(sq.replayed(d, F.col("batch"), 4, "deltas"), -60.0), "latch")


@query(
    "r7_freshness_monitor", "user_id:i latest:t health",
    """SELECT user_id, latest, CASE WHEN age < 0 THEN 'BLOCKED' WHEN age <= step THEN 'FRESH' WHEN age <= step + grace THEN 'WATCH' ELSE 'STALE' END AS health FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-30 22:00:00') // 1000000 - epoch_us(latest) // 1000000 AS age FROM x_latest)""",
)
def r7(t: Tables) -> DataFrame:
    s = event_stream(t).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    d = sq.run_complete(sq.latest_per_series(s, ["user_id"], "ts"), "freshness").withColumn("asset_class", asset_class(F.col("user_id")))
    return d.withColumns(quality.health(F.col("asset_class"), F.col("latest"), ts("2024-01-30 22:00:00"), F.lit(True), F.lit(True)))


fragment("x_life", "SELECT *, CASE WHEN entry % 50 = 7 THEN 'FINALIZED' ELSE kind END AS k2 FROM x_entries")


@query(
    "r8_session_lifecycle", "session_id:i entry:i accepted:b",
    """SELECT l.session_id, l.entry, coalesce(sequence <= f, true) AS accepted FROM x_life l LEFT JOIN (SELECT session_id, min(sequence) AS f FROM x_life WHERE k2 = 'FINALIZED' GROUP BY 1) USING (session_id)""",
)
def r8(t: Tables) -> DataFrame:
    e = entries(t.table("events"))
    return sq.after_final(e.withColumn("kind", F.when(F.col("entry") % 50 == 7, "FINALIZED").otherwise(F.col("kind"))))


@query(
    "r8_streamed_lifecycle", "session_id:i sequence:i entry:i accepted:b reason",
    """SELECT o.session_id, CASE WHEN timely AND nth <= coalesce(f, nth) THEN row_number() OVER (PARTITION BY o.session_id, timely ORDER BY nth) END AS sequence, entry, timely AND nth <= coalesce(f, nth) AS accepted,
 CASE WHEN nth > f THEN 'after_final' WHEN NOT timely THEN 'out_of_order' END AS reason
FROM x_in_order o LEFT JOIN (SELECT session_id, min(nth) AS f FROM x_in_order WHERE timely AND final_kind = 'FINALIZED' GROUP BY 1) USING (session_id)""",
)
def r8b(t: Tables) -> DataFrame:
    return sq.run_to_table(sq.chained(arriving(t, True)), "lifecycle")
