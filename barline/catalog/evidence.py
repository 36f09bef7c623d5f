"""Scalar functions, paths, folds, evidence tables, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.catalog.fragments import S

from barline.catalog.registry import Tables, fragment, query
from barline.functions import labels, prices, statistics as st
from barline.operators import evidence as ev
from barline.operators import features, neighbours, paths
from barline.plans.atlas import context_atlas, ranked_contexts
from barline.sources import store

DAY = 86400
GAIN = "coalesce(sum(v) FILTER (v > 0), 0)"
LOSS = "coalesce(-sum(v) FILTER (v < 0), 0)"
PF = f"{GAIN} / nullif({LOSS}, 0)"
WIN = "avg(CAST(v > 0 AS INT))"
TRADE = f"count(v) AS n, avg(v) AS expectancy, {WIN} AS win_rate, coalesce(avg(v) FILTER (v > 0), 0) AS avg_win, coalesce(avg(v) FILTER (v < 0), 0) AS avg_loss, {PF} AS profit_factor"
TRADE_SHAPE = "n:i expectancy:d win_rate:d avg_win:d avg_loss:d profit_factor:d"
REC = "(SELECT *, outcome_pips AS v FROM x_rec)"


def wilson_sql(rate: str, n: str, clamp: bool = True) -> tuple[str, str]:
    z = st.Z95
    centre = f"(({rate}) + {z * z} / (2 * ({n})))"
    half = f"{z} * sqrt(({rate}) * (1 - ({rate})) / ({n}) + {z * z} / (4.0 * ({n}) * ({n})))"
    low, high = (f"({centre} {s} {half}) / (1 + {z * z} / ({n}))" for s in "-+")
    return (f"greatest(0, {low})", f"least(1, {high})") if clamp else (low, high)


def drawdown_sql(source: str, keys: str, order: str = "ts, pair") -> str:
    """Drawdown and net profit per key of ``source`` rows with a value v."""
    return f"""SELECT {keys}, max(greatest(0, top) - cum) AS max_drawdown, sum(v) AS net_profit FROM (SELECT *, max(cum) OVER (PARTITION BY {keys} ORDER BY {order}) AS top
 FROM (SELECT *, sum(v) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS cum FROM {source})) GROUP BY {keys}"""


# ---- scalar functions


@query(
    "p1_session_label", "event_id:i session",
    "SELECT event_id, CASE WHEN hour(ts) < 7 THEN 'asia' WHEN hour(ts) < 13 THEN 'london' WHEN hour(ts) < 21 THEN 'new_york' ELSE 'rollover' END AS session FROM events",
)
def p1(t: Tables) -> DataFrame:
    return t.table("events").select("event_id", labels.session_label(F.col("ts").cast("timestamp")).alias("session"))


@query("p2_regime", "pair ts:t regime", "SELECT pair, ts, regime FROM x_tgt")
def p2(t: Tables) -> DataFrame:
    return neighbours.targets(t.states(), t.study)


@query(
    "p3_normal_symbol", "name strict loose n:i",
    """SELECT p_type AS name, upper(translate(trim(p_type), '/_-', '')) AS strict, upper(translate(trim(p_type), '/_', '')) AS loose, count(*) AS n
FROM (SELECT replace(p_type, ' ', '-') AS p_type FROM part) GROUP BY 1""",
)
def p3(t: Tables) -> DataFrame:
    d = t.table("part").select(F.regexp_replace("p_type", " ", "-").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("strict", labels.normal_symbol("name")).withColumn("loose", labels.normal_symbol("name", "/_"))


@query(
    "p4_pip_conversion", "pair n:i mean_pips:d",
    "SELECT pair, count(*) AS n, avg((bid_close - bid_open) / CASE WHEN pair LIKE '%/JPY' THEN 0.01::DOUBLE ELSE 0.0001::DOUBLE END) AS mean_pips FROM x_hbars GROUP BY 1",
)
def p4(t: Tables) -> DataFrame:
    move = (F.col("bid_close") - F.col("bid_open")) / labels.pip_size("pair")
    return t.hourly().groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.avg(move).alias("mean_pips"))


@query("p5_net_move", "pair ts:t horizon:i direction net:d", "SELECT pair, ts, horizon, direction, move - 0.0002::DOUBLE - 0.0001::DOUBLE AS net FROM x_out")
def p5(t: Tables) -> DataFrame:
    return t.outcomes().withColumn("net", prices.net_move(F.col("move"), 0.0002, 0.0001))


@query(
    "p6_cost_model", "linenumber:i total_cost:d net:d",
    """SELECT l_linenumber AS linenumber, avg(l_discount + l_tax + 0.1) AS total_cost, avg(l_extendedprice / 1000 - (l_discount + l_tax + 0.1)) AS net FROM lineitem GROUP BY 1""",
)
def p6(t: Tables) -> DataFrame:
    total = F.col("l_discount") + F.col("l_tax") + F.lit(0.1)
    return t.table("lineitem").groupBy(F.col("l_linenumber").alias("linenumber")).agg(
        F.avg(total).alias("total_cost"), F.avg(F.col("l_extendedprice") / 1000 - total).alias("net")
    )


AGREE_SQL = "CASE WHEN agreement < .5 THEN '<0.50' WHEN agreement < .6 THEN '0.50-0.59' WHEN agreement < .7 THEN '0.60-0.69' WHEN agreement < .8 THEN '0.70-0.79' ELSE '0.80+' END"
DIST_SQL = "CASE WHEN median_distance <= .5 THEN '<=0.50' WHEN median_distance <= 1 THEN '0.51-1.00' WHEN median_distance <= 1.5 THEN '1.01-1.50' WHEN median_distance <= 2 THEN '1.51-2.00' ELSE '>2.00' END"


@query("p7_agreement_band", "band n:i", f"SELECT {AGREE_SQL} AS band, count(*) AS n FROM x_rec GROUP BY 1")
def p7(t: Tables) -> DataFrame:
    return t.records().groupBy(labels.agreement_band("agreement").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("p8_distance_band", "band n:i", f"SELECT {DIST_SQL} AS band, count(*) AS n FROM x_rec GROUP BY 1")
def p8(t: Tables) -> DataFrame:
    return t.records().groupBy(labels.distance_band("median_distance").alias("band")).agg(F.count(F.lit(1)).alias("n"))


fragment("x_rich", f"""
SELECT *, outcome_pips AS v, month(ts) AS month, lower(dayname(ts)) AS weekday, hour(ts) AS hour_utc, printf('%02d:00-%02d', hour(ts), (hour(ts) + 1) % 24) AS hour_block_utc,
  {AGREE_SQL} AS agreement_band, {DIST_SQL} AS distance_band, CASE WHEN outcome_pips > 0 THEN 'win' WHEN outcome_pips < 0 THEN 'loss' ELSE 'flat' END AS outcome_sign FROM x_rec""")


@query(
    "p9_calendar_enrichment", "pair ts:t horizon:i year:i month:i weekday hour_utc:i hour_block_utc outcome_sign",
    "SELECT * FROM x_rich",
)
def p9(t: Tables) -> DataFrame:
    return ev.enriched(t.records())


_INV = "CASE WHEN avg_win > 0 AND avg_loss < 0 AND win_rate > 0 AND win_rate < 1 THEN (1 - win_rate) * -avg_loss / (win_rate * avg_win) END"


def inverted() -> Column:
    w, a, b = F.col("win_rate"), F.col("avg_win"), F.col("avg_loss")
    return F.when((a > 0) & (b < 0) & (w > 0) & (w < 1), (1 - w) * -b / (w * a))


@query("p10_inverted_profit_factor", "pair horizon:i inverted:d", f"SELECT *, {_INV} AS inverted FROM (SELECT pair, horizon, {TRADE} FROM {REC} GROUP BY 1, 2)")
def p10(t: Tables) -> DataFrame:
    return t.records().groupBy("pair", "horizon").agg(*st.trade_statistics("outcome_pips")).withColumn("inverted", inverted())


_W = (*wilson_sql("r", "n"), *wilson_sql("r", "n", clamp=False))


@query(
    "p11_wilson_interval", "custkey:i low:d high:d raw_low:d raw_high:d",
    f"SELECT custkey, {_W[0]} AS low, {_W[1]} AS high, {_W[2]} AS raw_low, {_W[3]} AS raw_high FROM (SELECT o_custkey AS custkey, avg(CAST(o_totalprice > 200000 AS INT)) AS r, count(*) AS n FROM orders GROUP BY 1)",
)
def p11(t: Tables) -> DataFrame:
    d = t.table("orders").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.avg((F.col("o_totalprice") > 200000).cast("double")).alias("r"), F.count(F.lit(1)).alias("n")
    )
    low, high = st.wilson(F.col("r"), F.col("n"))
    raw_low, raw_high = st.wilson(F.col("r"), F.col("n"), clamp=False)
    return d.select("custkey", low.alias("low"), high.alias("high"), raw_low.alias("raw_low"), raw_high.alias("raw_high"))


MARKET_FEATURES = ("return_5", "return_20", "range_20", "range_60", "volatility_20", "volatility_60", "trend_20_60", "spread")


@query(
    "p12_relative_distance", "pair ts:t distance:d",
    "SELECT pair, ts, sqrt(" + " + ".join(
        f"((f.{c} - f.p_{c}) / greatest(abs(f.{c}), abs(f.p_{c}), 1e-12)) ** 2" for c in ("momentum", "volatility", "atr", "range", "spread", "trend_strength")
    ) + ") AS distance FROM (SELECT *, " + ", ".join(
        f"lag({c}) OVER (PARTITION BY pair ORDER BY spos) AS p_{c}" for c in ("momentum", "volatility", "atr", "range", "spread", "trend_strength")
    ) + " FROM x_cs) f WHERE f.p_atr IS NOT NULL",
)
def p12(t: Tables) -> DataFrame:
    from barline.operators.ordering import in_blocks

    names = ("momentum", "volatility", "atr", "range", "spread", "trend_strength")

    def compute(d: DataFrame, window) -> DataFrame:  # noqa: ANN001
        return d.withColumns({f"p_{c}": F.lag(c).over(window()) for c in names})

    d = in_blocks(t.states(), ["pair"], "spos", 1, 0, compute, t.study.block_rows).filter(F.col("p_atr").isNotNull())
    return d.withColumn("distance", neighbours.relative_distance([(F.col(c), F.col(f"p_{c}")) for c in names]))


@query("p13_zscore_distance", "pair ts:t n:i nearest:d furthest:d", "SELECT pair, ts, count(*) AS n, min(distance) AS nearest, max(distance) AS furthest FROM x_nn GROUP BY 1, 2")
def p13(t: Tables) -> DataFrame:
    near = neighbours.nearest(t.states(), neighbours.targets(t.states(), t.study), t.study, t.study.neighbours)
    return near.groupBy("pair", "blk", "ts").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("nearest"), F.max("distance").alias("furthest"))


@query(
    "p14_fingerprint", "custkey:i fingerprint",
    """SELECT c_custkey AS custkey, sha256('{"custkey":' || c_custkey || ',"name":"' || c_name || '","nation":' || c_nationkey || ',"note":null}') AS fingerprint FROM customer""",
)
def p14(t: Tables) -> DataFrame:
    d = t.table("customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit(None).cast("string").alias("note")
    )
    return d.withColumn("fingerprint", store.fingerprint(["name", "custkey", "note", "nation"]))


@query("p15_logistic", "custkey:i p:d", "SELECT c_custkey AS custkey, 1 / (1 + exp(-c_acctbal / 1000)) AS p FROM customer")
def p15(t: Tables) -> DataFrame:
    return t.table("customer").select(F.col("c_custkey").alias("custkey"), st.logistic(F.col("c_acctbal") / 1000).alias("p"))


@query(
    "p16_perturbation_grid", "partkey:i value:d",
    "SELECT p_partkey AS partkey, p_retailprice * (1 + d) AS value FROM part, (VALUES (-0.10::DOUBLE), (-0.05::DOUBLE), (0.0::DOUBLE), (0.05::DOUBLE), (0.10::DOUBLE)) x(d)",
)
def p16(t: Tables) -> DataFrame:
    return t.table("part").select(F.col("p_partkey").alias("partkey"), F.explode(ev.perturbed(F.col("p_retailprice"))).alias("value"))


# ---- paths and folds


@query("w1_max_drawdown", "pair horizon:i direction max_drawdown:d net_profit:d", drawdown_sql(REC, "pair, horizon, direction"))
def w1(t: Tables) -> DataFrame:
    return paths.drawdown(t.records(), ["pair", "horizon", "direction"], "outcome_pips")


@query(
    "w1_drawdown_by_supplier", "suppkey:i max_drawdown:d",
    drawdown_sql("(SELECT l_suppkey AS suppkey, l_shipdate AS ts, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, (l_quantity - 25.5) AS v FROM lineitem)", "suppkey", "ts, ok, ln, pk"),
)
def w1b(t: Tables) -> DataFrame:
    d = t.table("lineitem").select(
        F.col("l_suppkey").alias("suppkey"), F.col("l_shipdate").cast("timestamp").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") - 25.5).alias("v")
    )
    return paths.drawdown(d, ["suppkey"], "v", ("ts", "l_orderkey", "l_linenumber", "l_partkey"), paths.time_block("ts", 90 * DAY))


fragment("x_ranked", f"""
SELECT *, row_number() OVER (PARTITION BY horizon, direction ORDER BY ts, pair) - 1 AS rn, count(*) OVER (PARTITION BY horizon, direction) AS n FROM {REC}""")


@query(
    "w2_equal_folds", "horizon:i direction fold:i n:i expectancy:d",
    "SELECT horizon, direction, least(rn // (n // 4), 3) AS fold, count(*) AS n, avg(v) AS expectancy FROM x_ranked GROUP BY 1, 2, 3",
)
def w2(t: Tables) -> DataFrame:
    d = paths.equal_folds(t.records(), ["horizon", "direction"], 4)
    return d.groupBy("horizon", "direction", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("outcome_pips").alias("expectancy"))


@query(
    "w3_index_folds", "horizon:i train_start:i train_end:i validation_start:i validation_end:i leakage_free:b",
    """SELECT horizon, s AS train_start, s + 399 AS train_end, s + 400 AS validation_start, s + 499 AS validation_end, true AS leakage_free
FROM (SELECT horizon, unnest(generate_series(0, n - 500, 100)) AS s FROM (SELECT horizon, count(*) AS n FROM x_rec GROUP BY 1))""",
)
def w3(t: Tables) -> DataFrame:
    n = t.records().groupBy("horizon").agg(F.count(F.lit(1)).alias("n"))
    return paths.index_folds(n, "n", 400, 100, 100)


@query(
    "w4_expanding_folds", "pair train_start:t train_end:t test_start:t test_end:t",
    """SELECT pair, lo AS train_start, e AS train_end, e + INTERVAL 12 HOUR AS test_start, e + INTERVAL 60 HOUR AS test_end
FROM (SELECT pair, lo, unnest(generate_series(lo + INTERVAL 5 DAY, hi - INTERVAL 60 HOUR, INTERVAL 36 HOUR)) AS e FROM (SELECT pair, min(ts) AS lo, max(ts) AS hi FROM x_rec GROUP BY 1))""",
)
def w4(t: Tables) -> DataFrame:
    return paths.expanding_folds(t.records(), ["pair"], 5 * DAY, 2 * DAY, 36 * 3600, 12 * 3600)


fragment("x_bounds", """
SELECT fold, start, lead(start) OVER (ORDER BY fold) AS stop FROM (SELECT f AS fold, ts AS start FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS n
 FROM (SELECT DISTINCT ts FROM x_rec WHERE global_split = 'confirmation')) JOIN (SELECT unnest(generate_series(0, 5)) AS f) ON idx = n * f // 6)""")
fragment("x_purged", f"""
SELECT r.*, outcome_pips AS v, fold, CASE WHEN ts < start + to_seconds(horizon * {S.interval_s}) THEN 'purged_start' WHEN stop IS NOT NULL AND ts + to_seconds(horizon * {S.interval_s}) >= stop THEN 'purged_end' ELSE 'kept' END AS purge
FROM x_rec r JOIN x_bounds ON ts >= start AND (stop IS NULL OR ts < stop) WHERE global_split = 'confirmation'""")


def purged(t: Tables) -> DataFrame:
    c = t.records().filter(F.col("global_split") == "confirmation")
    return paths.purged_folds(c, paths.purged_boundaries(c, 6, t.study.interval_s), t.study.interval_s)


@query("w5_purged_folds", "fold:i horizon:i purge n:i", "SELECT fold, horizon, purge, count(*) AS n FROM x_purged GROUP BY 1, 2, 3")
def w5(t: Tables) -> DataFrame:
    return purged(t).groupBy("fold", "horizon", "purge").agg(F.count(F.lit(1)).alias("n"))


@query("j17_fold_assignment", "pair ts:t horizon:i fold:i purge", "SELECT pair, ts, horizon, fold, purge FROM x_purged")
def j17(t: Tables) -> DataFrame:
    return purged(t)


@query(
    "w6_chronological_halves", "horizon:i direction half:i n:i expectancy:d",
    "SELECT horizon, direction, CASE WHEN rn < n // 2 THEN 1 ELSE 2 END AS half, count(*) AS n, avg(v) AS expectancy FROM x_ranked GROUP BY 1, 2, 3",
)
def w6(t: Tables) -> DataFrame:
    d = paths.halves(t.records(), ["horizon", "direction"])
    return d.groupBy("horizon", "direction", "half").agg(F.count(F.lit(1)).alias("n"), F.avg("outcome_pips").alias("expectancy"))


@query(
    "w7_gaps", "pair ts:t gap_s:i",
    "SELECT * FROM (SELECT pair, ts, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY pair ORDER BY ts) AS gap_s FROM x_hbars) WHERE gap_s > 3600",
)
def w7(t: Tables) -> DataFrame:
    from barline.operators.quality import gaps

    return gaps(t.hourly().drop("pos"), ["pair"], paths.time_block("ts", 30 * DAY)).filter(F.col("gap_s") > 3600)


@query(
    "w8_regime_transitions", "pair horizon:i from_state to_state observations:i probability:d mean_outcome:d",
    """SELECT pair, horizon, regime AS from_state, nxt AS to_state, count(*) AS observations, count(*) / sum(count(*)) OVER (PARTITION BY pair, horizon, regime) AS probability, avg(nv) AS mean_outcome
FROM (SELECT *, lead(regime) OVER (PARTITION BY pair, horizon ORDER BY ts) AS nxt, lead(outcome_pips) OVER (PARTITION BY pair, horizon ORDER BY ts) AS nv FROM x_rec) WHERE nxt IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def w8(t: Tables) -> DataFrame:
    return paths.transitions(t.records(), ["pair", "horizon"], "regime", "outcome_pips")


fragment("x_aligned", """
SELECT a.horizon, a.ts, a.pair AS pair_a, b.pair AS pair_b, a.outcome_pips AS value_a, b.outcome_pips AS value_b FROM x_rec a JOIN x_rec b ON a.horizon = b.horizon AND a.ts = b.ts AND a.pair < b.pair""")
fragment("x_lagged", """
SELECT horizon, pair_a, pair_b, n AS points, lag, coalesce(CASE WHEN isnan(corr(value_a, b)) THEN 0 ELSE corr(value_a, b) END, 0) AS correlation, count(*) AS observations
FROM (SELECT x.*, l.lag, y.value_b AS b FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY horizon, pair_a, pair_b) AS n FROM x_aligned WINDOW w AS (PARTITION BY horizon, pair_a, pair_b ORDER BY ts)) x
 CROSS JOIN (SELECT unnest(generate_series(-5, 5)) AS lag) l JOIN (SELECT *, row_number() OVER w AS rn FROM x_aligned WINDOW w AS (PARTITION BY horizon, pair_a, pair_b ORDER BY ts)) y
 ON y.horizon = x.horizon AND y.pair_a = x.pair_a AND y.pair_b = x.pair_b AND y.rn = x.rn + l.lag) WHERE n >= 20 GROUP BY ALL""")


@query("j11_aligned_pairs", "horizon:i ts:t pair_a pair_b value_a:d value_b:d", "SELECT * FROM x_aligned")
def j11(t: Tables) -> DataFrame:
    return paths.aligned_pairs(t.records(), ["horizon", "ts"], "pair", "outcome_pips")


def lagged(t: Tables) -> DataFrame:
    return paths.lagged_correlation(j11(t), ["horizon", "pair_a", "pair_b"])


@query("w9_lagged_correlation", "horizon:i pair_a pair_b points:i lag:i correlation:d observations:i", "SELECT * FROM x_lagged")
def w9(t: Tables) -> DataFrame:
    return lagged(t)


# ---- aggregates


@query("a1_trade_statistics", "pair horizon:i session " + TRADE_SHAPE, f"SELECT pair, horizon, session, {TRADE} FROM (SELECT *, outcome_pips - 0.2::DOUBLE AS v FROM x_rec) GROUP BY 1, 2, 3")
def a1(t: Tables) -> DataFrame:
    return t.records().groupBy("pair", "horizon", "session").agg(*st.trade_statistics("outcome_pips", 0.2))


@query(
    "a1_customer_orders", "custkey:i " + TRADE_SHAPE,
    f"SELECT o_custkey AS custkey, {TRADE} FROM (SELECT *, o_totalprice - 250000 AS v FROM orders) GROUP BY 1",
)
def a1b(t: Tables) -> DataFrame:
    return t.table("orders").groupBy(F.col("o_custkey").alias("custkey")).agg(*st.trade_statistics(F.col("o_totalprice") - 250000))


_PW = wilson_sql("r", "n")
SUMMARY = "n:i probability:d ci_low:d ci_high:d mean:d median:d"


@query(
    "a2_probability_summary", "pair horizon:i " + SUMMARY,
    f"SELECT *, r AS probability, {_PW[0]} AS ci_low, {_PW[1]} AS ci_high FROM (SELECT pair, horizon, count(*) AS n, {WIN} AS r, avg(v) AS mean, median(v) AS median FROM {REC} GROUP BY 1, 2)",
)
def a2(t: Tables) -> DataFrame:
    keys = ["pair", "horizon"]
    stats = t.records().groupBy(*keys).agg(*ev.probability_summary("outcome_pips"))
    return ev.with_median(stats, t.records(), keys, "outcome_pips")


@query(
    "a3_outcome_gate", "pair horizon:i n:i win_rate:d expectancy:d adverse:d allowed:b",
    """SELECT *, n >= 200 AND win_rate >= 0.55 AND expectancy >= 0 AND adverse <= 1 AS allowed FROM (SELECT pair, horizon, count(*) AS n, avg(CAST(move > 0 AS INT)) AS win_rate,
  avg(move) AS expectancy, avg(mae) AS adverse FROM x_out GROUP BY 1, 2)""",
)
def a3(t: Tables) -> DataFrame:
    d = t.outcomes().groupBy("pair", "horizon").agg(
        F.count(F.lit(1)).alias("n"), st.win_rate("move").alias("win_rate"), F.avg("move").alias("expectancy"), F.avg("mae").alias("adverse")
    )
    return d.withColumn("allowed", (F.col("n") >= 200) & (F.col("win_rate") >= 0.55) & (F.col("expectancy") >= 0) & (F.col("adverse") <= 1))


_EW = wilson_sql("win_rate", "n", clamp=False)
EVAL = f"count(*) AS n, avg(v) AS expectancy, {PF} AS profit_factor, {WIN} AS win_rate, median(v) AS median"
EVAL_SHAPE = "n:i expectancy:d profit_factor:d win_rate:d ci_low:d ci_high:d median:d"


@query(
    "a4_filtered_evaluation", "horizon:i " + EVAL_SHAPE,
    f"SELECT *, {_EW[0]} AS ci_low, {_EW[1]} AS ci_high FROM (SELECT horizon, {EVAL} FROM {REC} WHERE split = 'discovery' AND agreement >= 0.5 AND median_distance <= 1.5 GROUP BY 1)",
)
def a4(t: Tables) -> DataFrame:
    return ev.evaluation(ev.filtered(t.records(), "discovery", 1.5, 0.5), ["horizon"], "outcome_pips")


@query(
    "a5_extended_statistics", "pair horizon:i n:i expectancy:d profit_factor:d net_profit:d max_drawdown:d recovery_ratio:d",
    f"""SELECT s.*, net_profit, max_drawdown, CASE WHEN max_drawdown = 0 AND net_profit > 0 THEN 'inf'::DOUBLE WHEN max_drawdown > 0 THEN net_profit / max_drawdown ELSE 0 END AS recovery_ratio
FROM (SELECT pair, horizon, {TRADE} FROM {REC} GROUP BY 1, 2) s JOIN ({drawdown_sql(REC, "pair, horizon")}) d USING (pair, horizon)""",
)
def a5(t: Tables) -> DataFrame:
    s = t.records().groupBy("pair", "horizon").agg(*st.trade_statistics("outcome_pips"))
    return ev.with_path(s, t.records(), ["pair", "horizon"], "outcome_pips")


@query(
    "a6_group_breakdown", "spec horizon:i pair year:i direction " + TRADE_SHAPE,
    " UNION ALL ".join(
        f"SELECT '{c}' AS spec, horizon, {'pair' if c == 'pair' else 'NULL'} AS pair, {'year' if c == 'year' else 'NULL'} AS year, {'direction' if c == 'direction' else 'NULL'} AS direction, {TRADE} FROM {REC} GROUP BY horizon, {c}"
        for c in ("pair", "year", "direction")
    ),
)
def a6(t: Tables) -> DataFrame:
    sets = [("horizon", "pair"), ("horizon", "year"), ("horizon", "direction")]
    return ev.grouped(t.records(), sets, st.trade_statistics("outcome_pips"), ["pair", "year", "direction"])


@query(
    "a7_sequential_groups", "spec pair horizon:i value " + TRADE_SHAPE,
    " UNION ALL ".join(f"SELECT '{c}' AS spec, pair, horizon, CAST({c} AS VARCHAR) AS value, {TRADE} FROM {REC} GROUP BY pair, horizon, {c}" for c in ("session", "regime", "year")),
)
def a7(t: Tables) -> DataFrame:
    sets = [("pair", "horizon", c) for c in ("session", "regime", "year")]
    d = ev.grouped(t.records(), sets, st.trade_statistics("outcome_pips"), ["session", "regime", "year"])
    return d.withColumn("value", F.coalesce("session", "regime", F.col("year").cast("string")))


ATLAS_REPS, ATLAS_LOW, ATLAS_HIGH, ATLAS_SEED, ATLAS_STRONG, ATLAS_MINIMUM = 500, 12, 486, 20260825, 5, 3
ATLAS = "pair, horizon, regime, session, weekday, agreement_band, distance_band, direction, split"
fragment("x_cells", f"""
SELECT c.*, d.max_drawdown FROM (SELECT {ATLAS}, sum(n) AS n, sum(s) / sum(n) AS expectancy, sum(g) / nullif(sum(l), 0) AS profit_factor, sum(w) / sum(n) AS win_rate,
   count(*) FILTER (s > 0) AS positive_years, count(*) AS observed_years, positive_years / observed_years AS stability
  FROM (SELECT {ATLAS}, year, count(*) AS n, sum(v) AS s, {GAIN} AS g, {LOSS} AS l, count(*) FILTER (v > 0) AS w FROM x_rich GROUP BY ALL) GROUP BY ALL) c
JOIN ({drawdown_sql("x_rich", ATLAS)}) d USING ({ATLAS})""")


def atlas_cells(t: Tables) -> DataFrame:
    """Cells with their gated status; the SQL takes the bounds of large confirmation cells from the same draws (x_atlas)."""
    return t._keep("atlas", lambda: context_atlas(t.records(), ATLAS_REPS, ATLAS_LOW, ATLAS_HIGH, ATLAS_SEED, strong=ATLAS_STRONG, minimum=ATLAS_MINIMUM))


@query(
    "a8_context_atlas", "pair horizon:i regime session weekday agreement_band distance_band direction split n:i expectancy:d profit_factor:d win_rate:d positive_years:i observed_years:i max_drawdown:d median:d lower:d upper:d status",
    f"SELECT * FROM x_atlas JOIN (SELECT {ATLAS}, median(v) AS median FROM x_rich GROUP BY ALL) USING ({ATLAS})",
)
def a8(t: Tables) -> DataFrame:
    return atlas_cells(t)


@query(
    "a9_pair_overview", "pair n:i expectancy:d horizons regimes sessions weekdays",
    """SELECT pair, count(*) AS n, avg(v) AS expectancy, array_to_string(list_sort(list(DISTINCT horizon)), ',') AS horizons, array_to_string(list_sort(list(DISTINCT regime)), ',') AS regimes,
  array_to_string(list_sort(list(DISTINCT session)), ',') AS sessions, array_to_string(list_sort(list(DISTINCT weekday)), ',') AS weekdays FROM x_rich GROUP BY 1""",
)
def a9(t: Tables) -> DataFrame:
    found = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",").alias(c + "s")
    return ev.enriched(t.records()).groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), F.avg("outcome_pips").alias("expectancy"), *[found(c) for c in ("horizon", "regime", "session", "weekday")]
    )


_HIER = {
    "pair_horizon_regime_direction": "pair || '|' || horizon || '|' || regime || '|' || direction",
    "pair_horizon_regime_session_direction": "pair || '|' || horizon || '|' || regime || '|' || session || '|' || direction",
    "pair_horizon_regime_session": "pair || '|' || horizon || '|' || regime || '|' || session",
}
fragment("x_hier", f"""
SELECT spec, key, split, sum(n) AS n, sum(s) / sum(n) AS expectancy, sum(g) / nullif(sum(l), 0) AS profit_factor, sum(w) / sum(n) AS win_rate,
   count(*) FILTER (s > 0) AS positive_years, count(*) AS observed_years, positive_years / observed_years AS stability
FROM (SELECT spec, key, split, year, count(*) AS n, sum(v) AS s, {GAIN} AS g, {LOSS} AS l, count(*) FILTER (v > 0) AS w FROM (
""" + " UNION ALL ".join(f"SELECT '{k}' AS spec, {e} AS key, split, year, v FROM {REC}" for k, e in _HIER.items()) + ") GROUP BY ALL) GROUP BY ALL")


@query("a10_hierarchical_contexts", "spec key split n:i expectancy:d profit_factor:d win_rate:d positive_years:i observed_years:i stability:d", "SELECT * FROM x_hier")
def a10(t: Tables) -> DataFrame:
    return ev.hierarchy_cells(t.records())


_R = "coalesce(CASE WHEN isnan(corr(a, b)) THEN 0 ELSE corr(a, b) END, 0)"


@query(
    "a11_pearson", "returnflag quantity_price:d discount_tax:d",
    f"""SELECT l_returnflag AS returnflag, {_R.replace('a, b', 'l_quantity, l_extendedprice')} AS quantity_price, {_R.replace('a, b', 'l_discount, l_tax')} AS discount_tax FROM lineitem GROUP BY 1""",
)
def a11(t: Tables) -> DataFrame:
    return t.table("lineitem").groupBy(F.col("l_returnflag").alias("returnflag")).agg(
        st.pearson("l_quantity", "l_extendedprice").alias("quantity_price"), st.pearson("l_discount", "l_tax").alias("discount_tax")
    )


@query(
    "a12_correlation_matrix", "pair_a pair_b r:d n:i",
    f"""WITH r AS (SELECT pair, ts, bid_close / lag(bid_close) OVER (PARTITION BY pair ORDER BY ts) - 1 AS x FROM x_bars)
SELECT a.pair AS pair_a, b.pair AS pair_b, {_R.replace('a, b', 'a.x, b.x')} AS r, count(*) AS n FROM r a JOIN r b ON a.ts = b.ts WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2""",
)
def a12(t: Tables) -> DataFrame:
    return ev.correlation_matrix(features.one_bar_returns(t.bars(), t.study), ["ts"], "pair", "ret")


fragment("x_bins", """
SELECT horizon, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mean_probability, avg(y) AS rate, sum((p - y) ** 2) AS squared_error
FROM (SELECT horizon, agreement AS p, CAST(outcome_pips > 0 AS DOUBLE) AS y FROM x_rec) GROUP BY 1, 2""")


def binned(t: Tables) -> DataFrame:
    r = t.records().withColumn("won", (F.col("outcome_pips") > 0).cast("int"))
    return ev.calibration_bins(r, ["horizon"], "agreement", "won")


@query(
    "a13_calibration", "horizon:i n:i brier:d ece:d",
    "SELECT horizon, sum(n) AS n, sum(squared_error) / sum(n) AS brier, sum(n * abs(mean_probability - rate)) / sum(n) AS ece FROM x_bins GROUP BY 1",
)
def a13(t: Tables) -> DataFrame:
    return ev.calibration(binned(t), ["horizon"])


@query(
    "a13_document_quality_calibration", "lang n:i brier:d ece:d",
    """SELECT lang, sum(n) AS n, sum(se) / sum(n) AS brier, sum(n * abs(mp - r)) / sum(n) AS ece FROM (SELECT lang, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS r, sum((p - y) ** 2) AS se
 FROM (SELECT lang, n_chars / (n_chars + 1000.0::DOUBLE) AS p, CAST(quality AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id)) GROUP BY 1, 2) GROUP BY 1""",
)
def a13b(t: Tables) -> DataFrame:
    d = t.table("documents").select("doc_id", "lang", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("p")).join(t.table("labels"), "doc_id")
    return ev.calibration(ev.calibration_bins(d, ["lang"], "p", "quality"), ["lang"])


@query("a14_calibration_bins", "horizon:i bin:i n:i mean_probability:d rate:d", "SELECT * FROM x_bins")
def a14(t: Tables) -> DataFrame:
    return binned(t)


@query(
    "a15_brier", "pair horizon:i n:i brier:d predicted:d realised:d",
    """SELECT pair, horizon, count(*) AS n, avg((agreement - y) ** 2) AS brier, avg(agreement) AS predicted, avg(y) AS realised FROM (SELECT *, CAST(outcome_pips > 0 AS DOUBLE) AS y FROM x_rec) GROUP BY 1, 2""",
)
def a15(t: Tables) -> DataFrame:
    p, y = F.col("agreement"), (F.col("outcome_pips") > 0).cast("double")
    return t.records().groupBy("pair", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(p).alias("predicted"), F.avg(y).alias("realised")
    )


@query("a16_agreement_calibration", "horizon:i n:i mean_agreement:d positive_rate:d", f"SELECT horizon, count(*) AS n, avg(agreement) AS mean_agreement, {WIN} AS positive_rate FROM {REC} GROUP BY 1")
def a16(t: Tables) -> DataFrame:
    return t.records().groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("agreement").alias("mean_agreement"), st.win_rate("outcome_pips").alias("positive_rate"))


COST_SHAPE = "model cost:d n:i expectancy:d win_rate:d profit_factor:d"


@query(
    "a17_cost_stress", "horizon:i " + COST_SHAPE,
    f"SELECT horizon, model, cost, {TRADE} FROM (SELECT horizon, model, cost, outcome_pips - cost AS v FROM x_rec, (VALUES ('base', 0.4::DOUBLE), ('realistic', 0.8::DOUBLE), ('stress', 1.5::DOUBLE)) m(model, cost)) GROUP BY 1, 2, 3",
)
def a17(t: Tables) -> DataFrame:
    return ev.cost_curve(t.records(), ["horizon"], ev.COST_MODELS)


@query(
    "a18_drift", "horizon:i mean_shift:d volatility_ratio:d missing_shift:d drift:b",
    """SELECT *, mean_shift >= 0.5 OR volatility_ratio >= 1.5 OR missing_shift >= 0.1 AS drift FROM (SELECT horizon, abs(avg(v) FILTER (split = 'confirmation') - avg(v) FILTER (split = 'discovery')) AS mean_shift,
  stddev_pop(v) FILTER (split = 'confirmation') / stddev_pop(v) FILTER (split = 'discovery') AS volatility_ratio,
  abs(count(v) FILTER (split = 'confirmation') / count(*) FILTER (split = 'confirmation') - count(v) FILTER (split = 'discovery') / count(*) FILTER (split = 'discovery')) AS missing_shift
 FROM (SELECT horizon, split, CASE WHEN k % 10 <> 0 THEN outcome_pips END AS v FROM x_rec) GROUP BY 1)""",
)
def a18(t: Tables) -> DataFrame:
    r = t.records().withColumns(
        {
            "w": F.when(F.col("split") == "discovery", "reference").when(F.col("split") == "confirmation", "current"),
            "v": F.when(F.col("k") % 10 != 0, F.col("outcome_pips")),
        }
    )
    return ev.drift(r, ["horizon"], "w", "v")


@query(
    "a19_pair_diversity", "horizon:i direction eligible_pairs:i positive_pairs:i largest_share:d",
    f"""SELECT horizon, direction, count(*) FILTER (n >= 20) AS eligible_pairs, count(*) FILTER (n >= 20 AND expectancy > 0 AND profit_factor > 1) AS positive_pairs, max(n) / sum(n) AS largest_share
FROM (SELECT horizon, direction, pair, {TRADE} FROM {REC} GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def a19(t: Tables) -> DataFrame:
    return ev.pair_diversity(t.records(), ["horizon", "direction"])


@query("a20_stability_score", "pair score:d", f"SELECT pair, CASE WHEN avg(abs(e)) = 0 THEN 0 ELSE avg(CAST(e > 0 AS INT)) END AS score FROM (SELECT pair, session, avg(v) AS e FROM {REC} GROUP BY 1, 2) GROUP BY 1")
def a20(t: Tables) -> DataFrame:
    return t.records().groupBy("pair", "session").agg(F.avg("outcome_pips").alias("e")).groupBy("pair").agg(ev.stability_score("e").alias("score"))


@query(
    "a21_sensitivity", "parameter:d n:i metric:d",
    "SELECT p AS parameter, count(*) AS n, avg(outcome_pips) AS metric FROM x_rec, (SELECT 0.5::DOUBLE * (1 + d) AS p FROM (VALUES (-0.10::DOUBLE), (-0.05::DOUBLE), (0.0::DOUBLE), (0.05::DOUBLE), (0.10::DOUBLE)) x(d)) WHERE agreement >= p GROUP BY 1",
)
def a21(t: Tables) -> DataFrame:
    d = t.records().withColumn("parameter", F.explode(ev.perturbed(F.lit(0.5)))).filter(F.col("agreement") >= F.col("parameter"))
    return d.groupBy("parameter").agg(F.count(F.lit(1)).alias("n"), F.avg("outcome_pips").alias("metric"))


fragment("x_audit_cells", f"""
SELECT spec, grp, pair, horizon, {TRADE} FROM (""" + " UNION ALL ".join(f"SELECT '{c}' AS spec, CAST({c} AS VARCHAR) AS grp, pair, horizon, v FROM {REC}" for c in ("session", "regime", "year"))
    + ") GROUP BY 1, 2, 3, 4")
fragment("x_rollup", """
SELECT spec, grp, horizon, sum(n) AS n, sum(expectancy * n) / sum(n) AS expectancy, sum(n * win_rate * avg_win) / nullif(sum(n * (1 - win_rate) * -avg_loss), 0) AS profit_factor,
  count(*) FILTER (expectancy > 0) AS positive_pairs, count(*) FILTER (profit_factor > 1) AS pf_pairs FROM (SELECT * FROM x_audit_cells WHERE n >= 20) GROUP BY 1, 2, 3""")


def audit_cells(t: Tables) -> DataFrame:
    return a7(t).withColumnRenamed("value", "grp")


def rolled_up(cells: DataFrame) -> DataFrame:
    n, w = F.col("n"), F.col("win_rate")
    return cells.groupBy("spec", "grp", "horizon").agg(
        F.sum("n").alias("_n"), (F.sum(F.col("expectancy") * n) / F.sum("n")).alias("_e"),
        st.ratio(F.sum(n * w * F.col("avg_win")), F.sum(n * (1 - w) * -F.col("avg_loss"))).alias("_pf"),
        F.count_if(F.col("expectancy") > 0).alias("positive_pairs"), F.count_if(F.col("profit_factor") > 1).alias("pf_pairs"),
    ).withColumnsRenamed({"_n": "n", "_e": "expectancy", "_pf": "profit_factor"})


@query("a22_weighted_rollup", "spec grp horizon:i n:i expectancy:d profit_factor:d positive_pairs:i pf_pairs:i", "SELECT * FROM x_rollup")
def a22(t: Tables) -> DataFrame:
    return rolled_up(audit_cells(t).filter(F.col("n") >= 20))


@query(
    "a24_portfolio_totals", "segment positions:i risk:d symbols:i duplicates:i",
    """SELECT c_mktsegment AS segment, count(*) AS positions, sum(o_totalprice) / 1000000 AS risk, count(DISTINCT o_custkey) AS symbols, count(*) - count(DISTINCT o_custkey) AS duplicates
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1""",
)
def a24(t: Tables) -> DataFrame:
    from barline.plans.portfolio import portfolio_totals

    o = t.table("orders").filter(F.col("o_orderstatus") == "O").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    d = o.join(t.table("customer").select("c_custkey", "c_mktsegment", "c_name"), "c_custkey")
    d = d.select(F.col("c_mktsegment").alias("asset_class"), F.col("c_name").alias("symbol"), (F.col("o_totalprice") / 1000000).alias("risk"))
    return portfolio_totals(d).withColumnRenamed("asset_class", "segment")


_VOTE = "SELECT l_orderkey AS decision, CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'R' THEN 'SELL' ELSE 'NO_TRADE' END AS direction, 0.5 + l_discount * 5 AS confidence, l_quantity / 50 AS strength FROM lineitem"
fragment("x_votes", _VOTE)
fragment("x_consensus", """
SELECT *, coalesce(CAST(least(buy, sell) AS DOUBLE) / nullif(CAST(buy + sell AS DOUBLE), 0), 1) AS disagreement FROM (SELECT decision, count(*) FILTER (ok) AS eligible,
  coalesce(sum(w) FILTER (ok AND direction = 'BUY'), 0) AS buy, coalesce(sum(w) FILTER (ok AND direction = 'SELL'), 0) AS sell
  FROM (SELECT *, TRY_CAST(confidence AS DECIMAL(28,12)) AS w, confidence >= 0.65 AND direction <> 'NO_TRADE' AS ok FROM x_votes) GROUP BY 1)""")


def votes(t: Tables) -> DataFrame:
    return t.table("lineitem").select(
        F.col("l_orderkey").alias("decision"), F.when(F.col("l_returnflag") == "A", "BUY").when(F.col("l_returnflag") == "R", "SELL").otherwise("NO_TRADE").alias("direction"),
        (0.5 + F.col("l_discount") * 5).alias("confidence"), (F.col("l_quantity") / 50).alias("strength"),
    )


@query(
    "a25_expert_consensus", "decision:i action direction confidence:d reason",
    """SELECT decision, CASE WHEN eligible > 0 AND disagreement <= 0.25 THEN 'ROUTE' ELSE 'ABSTAIN' END AS action, CASE WHEN eligible > 0 AND disagreement <= 0.25 THEN CASE WHEN buy > sell THEN 'BUY' ELSE 'SELL' END END AS direction,
  CASE WHEN eligible > 0 AND disagreement <= 0.25 THEN CAST(greatest(buy, sell) AS DOUBLE) / CAST(buy + sell AS DOUBLE) ELSE 0 END AS confidence,
  CASE WHEN eligible = 0 THEN 'no sufficiently confident directional expert' WHEN disagreement > 0.25 THEN 'expert disagreement exceeds threshold' ELSE 'dominant expert consensus' END AS reason FROM x_consensus""",
)
def a25(t: Tables) -> DataFrame:
    return ev.expert_consensus(votes(t), ["decision"])


@query(
    "a25_domain_consensus", "decision:i consensus confidence:d reasons",
    """SELECT decision, CASE WHEN go THEN CASE WHEN buy > sell THEN 'BUY' ELSE 'SELL' END ELSE 'NO_TRADE' END AS consensus, CASE WHEN go THEN least(0.99, CAST(greatest(buy, sell) AS DOUBLE) / CAST(buy + sell AS DOUBLE)) ELSE 0 END AS confidence,
  concat_ws(',', CASE WHEN q <= 0 THEN 'context_quality_zero' END, CASE WHEN eligible = 0 THEN 'no_sufficiently_confident_experts' END, CASE WHEN eligible > 0 AND dis > 0.25 THEN 'expert_disagreement' END,
   CASE WHEN eligible > 0 AND q < 0.7 THEN 'context_quality_below_operating_floor' END) AS reasons
FROM (SELECT *, eligible > 0 AND dis <= 0.25 AND q >= 0.7 AS go FROM (SELECT *, coalesce(CAST(least(buy, sell) AS DOUBLE) / nullif(CAST(buy + sell AS DOUBLE), 0), 1) AS dis, (decision % 10) / 8.0::DOUBLE AS q
  FROM (SELECT decision, count(*) FILTER (ok) AS eligible, coalesce(sum(w) FILTER (ok AND direction = 'BUY'), 0) AS buy, coalesce(sum(w) FILTER (ok AND direction = 'SELL'), 0) AS sell
  FROM (SELECT *, TRY_CAST(confidence * strength AS DECIMAL(28,12)) AS w, confidence >= 0.65 AND direction <> 'NO_TRADE' AS ok FROM x_votes) GROUP BY 1)))""",
)
def a25b(t: Tables) -> DataFrame:
    d = ev.domain_consensus(votes(t), ["decision"], F.col("decision") % 10 / 8.0)
    return d.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "a26_neighbour_counters", "pair horizon:i targets:i mean_neighbours:d mean_distance:d rejected:i",
    "SELECT pair, horizon, count(*) AS targets, avg(k) AS mean_neighbours, avg(median_distance) AS mean_distance, count(*) FILTER (k < 30) AS rejected FROM x_rec GROUP BY 1, 2",
)
def a26(t: Tables) -> DataFrame:
    return t.records().groupBy("pair", "horizon").agg(
        F.count(F.lit(1)).alias("targets"), F.avg("k").alias("mean_neighbours"), F.avg("median_distance").alias("mean_distance"), F.count_if(F.col("k") < 30).alias("rejected")
    )


@query(
    "a27_gate_rollup", "pair horizon:i state failed",
    f"""SELECT pair, horizon, CASE WHEN n < 100 THEN 'INCOMPLETE' WHEN expectancy > 0 AND profit_factor > 1 AND win_rate > 0.5 THEN 'PASS' ELSE 'FAIL' END AS state,
  concat_ws(',', CASE WHEN NOT expectancy > 0 THEN 'expectancy_positive' END, CASE WHEN NOT profit_factor > 1 THEN 'profit_factor_gt_1' END, CASE WHEN NOT win_rate > 0.5 THEN 'win_rate_gt_half' END) AS failed
FROM (SELECT pair, horizon, {TRADE} FROM {REC} WHERE split = 'confirmation' GROUP BY 1, 2)""",
)
def a27(t: Tables) -> DataFrame:
    d = t.records().filter(F.col("split") == "confirmation").groupBy("pair", "horizon").agg(*st.trade_statistics("outcome_pips"))
    gates = {"expectancy_positive": F.col("expectancy") > 0, "profit_factor_gt_1": F.col("profit_factor") > 1, "win_rate_gt_half": F.col("win_rate") > 0.5}
    return d.withColumns(ev.verdict(gates, F.col("n") >= 100)).withColumn("failed", F.array_join("failed", ","))


@query(
    "a28_audit_summary", "records:i pairs:i transitions:i bins:i ready:b",
    """SELECT *, records > 0 AND pairs > 1 AND transitions > 0 AND bins > 0 AS ready FROM (SELECT (SELECT count(*) FROM x_rec) AS records, (SELECT count(DISTINCT pair) FROM x_rec) AS pairs, (SELECT count(*) FROM (SELECT DISTINCT pair, horizon, regime, nxt FROM (SELECT *, lead(regime) OVER (PARTITION BY pair, horizon ORDER BY ts) AS nxt FROM x_rec) WHERE nxt IS NOT NULL)) AS transitions,
  (SELECT count(*) FROM x_bins) AS bins)""",
)
def a28(t: Tables) -> DataFrame:
    r = t.records().agg(F.count(F.lit(1)).alias("records"), F.count_distinct("pair").alias("pairs"))
    n = lambda d: d.agg(F.count(F.lit(1)).alias("n")).scalar()
    d = r.withColumn("transitions", n(w8(t))).withColumn("bins", n(binned(t)))
    return d.withColumn("ready", (F.col("records") > 0) & (F.col("pairs") > 1) & (F.col("transitions") > 0) & (F.col("bins") > 0))


# ---- candidates and rankings

GRID_SQL = """(SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75])::DOUBLE AS agreement_min), (SELECT unnest([NULL, 0.5, 1.0, 1.5, 2.0])::DOUBLE AS distance_max)"""
fragment("x_sets", "SELECT *, 'all' AS pairset, outcome_pips AS v FROM x_rec UNION ALL SELECT *, 'JPY', outcome_pips FROM x_rec WHERE pair LIKE '%/JPY'")
fragment("x_grid_hits", f"""
SELECT * FROM x_sets, {GRID_SQL} WHERE agreement >= agreement_min AND (distance_max IS NULL OR median_distance <= distance_max)""")
KEYS = "horizon, regime, session, pairset, direction"
fragment("x_grid", f"SELECT {KEYS}, agreement_min, distance_max, {TRADE} FROM x_grid_hits WHERE global_split = 'discovery' GROUP BY {KEYS}, agreement_min, distance_max")
POINT = "horizon:i regime session pairset direction agreement_min:d distance_max:d"
KEY_LIST = ["horizon", "regime", "session", "pairset", "direction"]


def discovery_grid(t: Tables) -> DataFrame:
    r = ev.in_pairset(t.records().filter(F.col("global_split") == "discovery"))
    return ev.grid_cells(r, KEY_LIST)


@query("j18_candidate_matching", POINT + " n:i expectancy:d profit_factor:d win_rate:d", "SELECT * FROM x_grid")
def j18(t: Tables) -> DataFrame:
    return discovery_grid(t)


@query(
    "j18_candidate_records", POINT + " n:i mean_distance:d",
    f"SELECT {KEYS}, agreement_min, distance_max, count(*) AS n, avg(median_distance) AS mean_distance FROM x_grid_hits WHERE global_split = 'confirmation' AND pairset = 'all' GROUP BY {KEYS}, agreement_min, distance_max",
)
def j18b(t: Tables) -> DataFrame:
    grid = ev.candidate_grid(t.spark, t.study.horizons)
    r = t.records().filter(F.col("global_split") == "confirmation").withColumn("pairset", F.lit("all"))
    hits = ev.matching(r, grid, KEY_LIST)
    return hits.groupBy(*KEY_LIST, "agreement_min", "distance_max").agg(F.count(F.lit(1)).alias("n"), F.avg("median_distance").alias("mean_distance"))


TWO = "(SELECT *, outcome_pips AS v FROM x_two)"


@query("j19_two_sided_matching", "horizon:i k:i " + TRADE_SHAPE, f"SELECT horizon, k, {TRADE} FROM {TWO} WHERE global_split = 'confirmation' GROUP BY 1, 2")
def j19(t: Tables) -> DataFrame:
    grid = ev.explode_values(ev.explode_values(t.spark.range(1).select(), "horizon", t.study.horizons, "bigint"), "k", t.study.k_values, "bigint")
    c = t.two_sided().filter(F.col("global_split") == "confirmation").join(F.broadcast(grid), ["horizon", "k"])
    return c.groupBy("horizon", "k").agg(*st.trade_statistics("outcome_pips"))


@query(
    "j20_discovery_to_confirmation", "spec key n:i expectancy:d c_n:i c_expectancy:d",
    """SELECT d.spec, d.key, d.n, d.expectancy, c.n AS c_n, c.expectancy AS c_expectancy FROM x_hier d JOIN x_hier c ON d.spec = c.spec AND d.key = c.key
WHERE d.split = 'discovery' AND c.split = 'confirmation' AND d.n >= 10 AND c.n >= 10 AND d.expectancy > 0 AND d.profit_factor > 1""",
)
def j20(t: Tables) -> DataFrame:
    cells = ev.hierarchy_cells(t.records()).filter(F.col("n") >= 10)
    d = cells.filter((F.col("split") == "discovery") & ev.survives()).select("spec", "key", "n", "expectancy")
    c = cells.filter(F.col("split") == "confirmation").select("spec", "key", F.col("n").alias("c_n"), F.col("expectancy").alias("c_expectancy"))
    return d.join(c, ["spec", "key"])


@query(
    "j21_candidate_grid", POINT + " covered:i",
    f"""SELECT g.*, coalesce(c.n, 0) AS covered FROM (SELECT * FROM (SELECT unnest([1, 2, 3, 6]) AS horizon), {GRID_SQL}, (SELECT unnest({list(ev.REGIMES)!r}) AS regime),
 (SELECT unnest(['asia', 'london', 'new_york', 'rollover']) AS session), (SELECT 'all' AS pairset), (SELECT unnest(['long', 'short']) AS direction)) g
LEFT JOIN x_grid c ON c.horizon = g.horizon AND c.regime = g.regime AND c.session = g.session AND c.pairset = g.pairset AND c.direction = g.direction AND c.agreement_min = g.agreement_min AND c.distance_max IS NOT DISTINCT FROM g.distance_max""",
)
def j21(t: Tables) -> DataFrame:
    grid, cells = ev.candidate_grid(t.spark, t.study.horizons), discovery_grid(t)
    on = [grid[c] == cells[c] for c in (*KEY_LIST, "agreement_min")] + [grid["distance_max"].eqNullSafe(cells["distance_max"])]
    joined = grid.join(cells, on, "left")
    return joined.select(*[grid[c] for c in (*KEY_LIST, "agreement_min", "distance_max")], F.coalesce(cells["n"], F.lit(0)).alias("covered"))


@query(
    "j22_profile_filter", "asset_class custkey:i features:i",
    """SELECT asset_class, c_custkey AS custkey, CASE asset_class WHEN 'EQUITY' THEN 11 ELSE 10 END AS features FROM (SELECT c_custkey, ['FOREX','CRYPTO','METAL','COMMODITY','EQUITY','INDEX'][c_custkey % 6 + 1] AS asset_class FROM customer)
WHERE asset_class IN ('EQUITY', 'INDEX')""",
)
def j22(t: Tables) -> DataFrame:
    from barline.functions.dimensions import required_features

    kinds = F.array(*[F.lit(c) for c in ("FOREX", "CRYPTO", "METAL", "COMMODITY", "EQUITY", "INDEX")])
    d = t.table("customer").select(F.col("c_custkey").alias("custkey"), F.element_at(kinds, (F.col("c_custkey") % 6 + 1).cast("int")).alias("asset_class"))
    return d.filter(F.col("asset_class").isin("EQUITY", "INDEX")).withColumn("features", F.size(required_features(F.col("asset_class"))))


def tie() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in (*KEY_LIST, "agreement_min", "distance_max")]


_TIE_SQL = "horizon, regime, session, pairset, direction, agreement_min, distance_max NULLS FIRST"


@query(
    "k2_top_candidates", POINT + " n:i expectancy:d profit_factor:d",
    f"SELECT * FROM x_grid WHERE n >= 10 ORDER BY round(expectancy, 6) DESC, round(profit_factor, 6) DESC NULLS LAST, {_TIE_SQL} LIMIT 10",
)
def k2(t: Tables) -> DataFrame:
    order = [F.round("expectancy", 6).desc(), F.round("profit_factor", 6).desc_nulls_last(), *tie()]
    return ev.top(discovery_grid(t).filter(F.col("n") >= 10), order, 10)


@query(
    "k3_top_per_hierarchy", "spec key n:i expectancy:d rank:i",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY round(expectancy, 6) DESC, round(profit_factor, 6) DESC NULLS LAST, n DESC, key) AS rank FROM x_hier WHERE split = 'discovery' AND n >= 10 AND expectancy > 0 AND profit_factor > 1) WHERE rank <= 20""",
)
def k3(t: Tables) -> DataFrame:
    cells = ev.hierarchy_cells(t.records()).filter((F.col("split") == "discovery") & (F.col("n") >= 10) & ev.survives())
    order = [F.round("expectancy", 6).desc(), F.round("profit_factor", 6).desc_nulls_last(), F.col("n").desc(), F.col("key")]
    return ev.top_per(cells, ["spec"], order, 20)


fragment("x_halves", """
SELECT horizon, regime, direction, avg(v) FILTER (rn < n // 2) AS first_half, avg(v) FILTER (rn >= n // 2) AS second_half, any_value(n) AS n FROM (SELECT *, outcome_pips AS v,
 row_number() OVER (PARTITION BY horizon, regime, direction ORDER BY ts, pair) - 1 AS rn, count(*) OVER (PARTITION BY horizon, regime, direction) AS n FROM x_rec WHERE split = 'discovery') GROUP BY 1, 2, 3""")


@query(
    "k4_finalists_by_halves", "horizon:i regime direction first_half:d second_half:d n:i",
    "SELECT * FROM x_halves WHERE n >= 10 ORDER BY round(least(first_half, second_half), 6) DESC, horizon, regime, direction LIMIT 20",
)
def k4(t: Tables) -> DataFrame:
    keys = ["horizon", "regime", "direction"]
    d = paths.halves(t.records().filter(F.col("split") == "discovery"), keys).groupBy(*keys).agg(
        F.avg(F.when(F.col("half") == 1, F.col("outcome_pips"))).alias("first_half"), F.avg(F.when(F.col("half") == 2, F.col("outcome_pips"))).alias("second_half"), F.max("n").alias("n")
    )
    return ev.top(d.filter(F.col("n") >= 10), [F.round(F.least("first_half", "second_half"), 6).desc(), *keys], 20)


@query(
    "k5_contexts_per_status", "status pair horizon:i regime session weekday agreement_band distance_band direction n:i expectancy:d rank:i",
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY CASE WHEN status = 'NO_TRADE' THEN 1 ELSE -1 END * round(expectancy, 6), CASE WHEN status = 'NO_TRADE' THEN 1 ELSE -1 END * n, {ATLAS}) AS rank FROM x_atlas WHERE split = 'confirmation' AND status <> 'UNKNOWN') WHERE rank <= 250",
)
def k5(t: Tables) -> DataFrame:
    return ranked_contexts(atlas_cells(t))


@query(
    "k6_inversion_candidates", "pair horizon:i inverted:d",
    f"SELECT * FROM (SELECT *, {_INV} AS inverted FROM (SELECT pair, horizon, {TRADE} FROM {REC} GROUP BY 1, 2)) WHERE expectancy < 0 AND inverted > 1 ORDER BY round(inverted, 6) DESC, pair, horizon LIMIT 30",
)
def k6(t: Tables) -> DataFrame:
    d = p10(t).filter((F.col("expectancy") < 0) & (F.col("inverted") > 1))
    return ev.top(d, [F.round("inverted", 6).desc(), F.col("pair"), F.col("horizon")], 30)


@query(
    "k7_time_sets", "pair ts:t side",
    "SELECT DISTINCT pair, ts, CASE WHEN ts IN (SELECT ts FROM x_hbars WHERE pair = 'VIEW/USD') THEN 'common' ELSE 'missing' END AS side FROM x_hbars WHERE pair <> 'VIEW/USD'",
)
def k7(t: Tables) -> DataFrame:
    a = t.hourly().filter(F.col("pair") != "VIEW/USD").select("pair", "ts").distinct()
    b = t.hourly().filter(F.col("pair") == "VIEW/USD").select("ts").distinct().withColumn("_in", F.lit(True))
    return a.join(b, "ts", "left").select("pair", "ts", F.when(F.col("_in"), "common").otherwise("missing").alias("side"))


@query(
    "k7_time_set_sizes", "pair_a pair_b common:i only_a:i only_b:i",
    """WITH s AS (SELECT DISTINCT pair, ts FROM x_hbars), n AS (SELECT pair, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.pair AS pair_a, b.pair AS pair_b, count(*) AS common FROM s a JOIN s b ON a.ts = b.ts AND a.pair < b.pair GROUP BY 1, 2)
SELECT a.pair AS pair_a, b.pair AS pair_b, coalesce(common, 0) AS common, a.n - coalesce(common, 0) AS only_a, b.n - coalesce(common, 0) AS only_b FROM n a JOIN n b ON a.pair < b.pair LEFT JOIN c ON c.pair_a = a.pair AND c.pair_b = b.pair""",
)
def k7b(t: Tables) -> DataFrame:
    return ev.time_set_sizes(ev.time_sets(t.hourly(), "pair", 3600), "pair")


@query("k8_union_of_pairs", "pair n:i", "SELECT pair, count(*) AS n FROM x_rec GROUP BY 1 UNION ALL SELECT 'two-sided ' || pair, count(*) FROM x_two GROUP BY 1")
def k8(t: Tables) -> DataFrame:
    one = t.records().select("pair", "ts", "outcome_pips")
    two = t.two_sided().select(F.concat(F.lit("two-sided "), F.col("pair")).alias("pair"), "ts", "outcome_pips")
    return one.unionByName(two).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k9_near_misses", POINT + " n:i reason",
    f"""SELECT *, CASE WHEN profit_factor IS NULL OR profit_factor < 1.1 THEN 'failed discovery profit-factor gate' ELSE 'failed expectancy gate' END AS reason FROM x_grid
WHERE n >= 10 AND (profit_factor IS NULL OR profit_factor < 1.1 OR expectancy <= 0) ORDER BY round(profit_factor, 6) DESC NULLS LAST, n DESC, {_TIE_SQL} LIMIT 25""",
)
def k9(t: Tables) -> DataFrame:
    low = F.col("profit_factor").isNull() | (F.col("profit_factor") < 1.1)
    d = discovery_grid(t).filter((F.col("n") >= 10) & (low | (F.col("expectancy") <= 0)))
    d = d.withColumn("reason", F.when(low, "failed discovery profit-factor gate").otherwise("failed expectancy gate"))
    return ev.top(d, [F.round("profit_factor", 6).desc_nulls_last(), F.col("n").desc(), *tie()], 25)


@query(
    "k10_distinct_reasons", "orderkey:i reasons",
    """SELECT o_orderkey AS orderkey, CASE WHEN o_orderstatus = o_orderpriority[1:1] THEN o_orderstatus ELSE o_orderstatus || ',' || o_orderpriority[1:1] END || ',x' AS reasons FROM orders""",
)
def k10(t: Tables) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    reasons = F.array_distinct(F.array(F.col("o_orderstatus"), first, F.col("o_orderstatus"), F.lit("x"), first))
    return t.table("orders").select(F.col("o_orderkey").alias("orderkey"), F.array_join(reasons, ",").alias("reasons"))


