"""Validation, resampling, side joins, intervals and planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.catalog.registry import Tables, fragment, query
from barline.functions import labels, prices
from barline.functions.dimensions import REQUIRED_FEATURES, VOLUME_CLASSES, CALENDAR_CLASSES, research_contract_ok, required_features
from barline.operators import intervals, quality, resample
from barline.operators.ordering import time_block
from barline.sources import feeds

SIDE = ["pair", "timeframe", "offer_side"]
DAYS = 86400


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def month() -> Column:
    return time_block("ts", 30 * DAYS)


fragment("x_odd", """
SELECT pair, ts, pos, bid_open, CASE WHEN pos % 17 = 0 THEN bid_high / 2 ELSE bid_high END AS bid_high, bid_low,
  CASE WHEN pos % 19 = 0 THEN NULL ELSE bid_close END AS bid_close, ask_open, ask_high, ask_low,
  CASE WHEN pos % 13 = 0 THEN ask_close - 1 ELSE ask_close END AS ask_close FROM x_hbars""")


def odd(t: Tables) -> DataFrame:
    """Hourly bars with faults at fixed positions, for the predicates to find."""
    p = F.col("pos")
    return t.hourly().withColumns(
        {
            "bid_high": F.when(p % 17 == 0, F.col("bid_high") / 2).otherwise(F.col("bid_high")),
            "bid_close": F.when(p % 19 == 0, None).otherwise(F.col("bid_close")),
            "ask_close": F.when(p % 13 == 0, F.col("ask_close") - 1).otherwise(F.col("ask_close")),
        }
    )


@query(
    "v1_ohlc_geometry", "returnflag ok:i bad:i",
    """SELECT l_returnflag AS returnflag, count(*) FILTER (g) AS ok, count(*) FILTER (NOT g) AS bad FROM (SELECT l_returnflag,
 h >= greatest(o, c) AND l <= least(o, c) AND l <= h AS g FROM (SELECT l_returnflag, l_quantity AS o, l_tax * 600 AS c, l_extendedprice / 1500 AS h, l_discount * 100 AS l FROM lineitem)) GROUP BY 1""",
)
def v1(t: Tables) -> DataFrame:
    d = t.table("lineitem").select(
        F.col("l_returnflag").alias("returnflag"), F.col("l_quantity").alias("open"), (F.col("l_tax") * 600).alias("close"),
        (F.col("l_extendedprice") / 1500).alias("high"), (F.col("l_discount") * 100).alias("low"),
    ).withColumn("g", prices.geometry_ok())
    return d.groupBy("returnflag").agg(F.count_if("g").alias("ok"), F.count_if(~F.col("g")).alias("bad"))


@query(
    "v2_paired_bar_predicate", "pair ts:t ok:b",
    """SELECT pair, ts, coalesce(bid_close > 0 AND bid_low > 0 AND ask_close > 0 AND bid_high >= greatest(bid_open, bid_close) AND bid_low <= least(bid_open, bid_close)
 AND ask_high >= greatest(ask_open, ask_close) AND ask_low <= least(ask_open, ask_close) AND ask_close >= bid_close AND ask_open >= bid_open, false) AS ok FROM x_odd""",
)
def v2(t: Tables) -> DataFrame:
    return odd(t).withColumn("ok", F.coalesce(prices.paired_ok(), F.lit(False)))


@query(
    "v3_feed_numbers", "pair ts:t ok:b",
    """SELECT pair, ts, coalesce(bid_close > 0 AND bid_low > 0 AND ask_close > 0 AND bid_high >= greatest(bid_open, bid_close) AND bid_low <= least(bid_open, bid_close)
 AND ask_high >= greatest(ask_open, ask_close) AND ask_low <= least(ask_open, ask_close), false) AS ok FROM x_odd""",
)
def v3(t: Tables) -> DataFrame:
    d = odd(t).withColumn("timestamp", F.unix_millis("ts").cast("double"))
    return d.withColumn("ok", F.coalesce(feeds.feed_bar_ok(), F.lit(False)))


@query(
    "v4_crossed_bars", "pair rows:i crossed:i crossed_share:d accepted:b",
    """SELECT pair, count(*) AS rows, count(*) FILTER (coalesce(ask_open < bid_open, false) OR coalesce(ask_close < bid_close, false)) AS crossed,
  crossed / rows AS crossed_share, crossed_share <= 0.001 AS accepted FROM x_odd GROUP BY pair""",
)
def v4(t: Tables) -> DataFrame:
    return feeds.crossed_report(odd(t))


@query(
    "v5_integrity", "pair offer_side rows:i duplicates:i invalid_spans:i missing:i strictly_increasing:b ok:b",
    """SELECT pair, offer_side, count(*) AS rows, 0 AS duplicates, 0 AS invalid_spans,
  sum(CASE WHEN gap > 3600 THEN greatest(1, gap // 3600 - 1) ELSE 0 END) AS missing, true AS strictly_increasing, true AS ok
FROM (SELECT *, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY pair, offer_side ORDER BY ts) AS gap FROM x_sided) GROUP BY 1, 2""",
)
def v5(t: Tables) -> DataFrame:
    return quality.integrity(t.sided(), SIDE, month())


@query(
    "v6_side_alignment", "pair missing_ask:i missing_bid:i both:i aligned:b",
    """SELECT pair, count(*) FILTER (volume = 1) AS missing_ask, 0 AS missing_bid, count(*) FILTER (volume > 1) AS both, missing_ask = 0 AS aligned
FROM x_hbars GROUP BY pair""",
)
def v6(t: Tables) -> DataFrame:
    return resample.side_alignment(t.sided().filter((F.col("offer_side") == "B") | (F.col("volume") > 1)))


@query(
    "v7_provider_contract", "feed offer_side ts:t reason",
    """SELECT pair AS feed, offer_side, ts, concat_ws(',', CASE WHEN offer_side <> 'B' THEN 'unexpected offer side' END,
  CASE WHEN ts < TIMESTAMP '2024-01-03' OR ts >= TIMESTAMP '2024-01-25' THEN 'outside the requested interval' END, 'duplicate timestamps') AS reason FROM x_sided""",
)
def v7(t: Tables) -> DataFrame:
    requests = t.hourly().select("pair").distinct().select(
        F.col("pair").alias("feed"), "pair", F.lit("1hour").alias("timeframe"), F.lit("B").alias("offer_side"),
        ts("2024-01-03").alias("start"), ts("2024-01-25").alias("end"),
    )
    out = quality.contract_violations(t.sided().withColumn("feed", F.col("pair")), requests)
    return out.withColumn("reason", F.array_join("reasons", ","))


_LATE = "ts + INTERVAL 30 MINUTE"


@query(
    "v8_sequence_check", "sequence ordered:b one_identity:b rows:i valid:b",
    f"""SELECT sequence, bool_and(coalesce(epoch(ts) - epoch(before) > 0, true)) AS ordered, count(DISTINCT pair || timeframe || offer_side) = 1 AS one_identity, count(*) AS rows, ordered AND one_identity AS valid
FROM (SELECT *, lag(ts) OVER (PARTITION BY sequence ORDER BY ts) AS before FROM (
 SELECT pair || ' ' || offer_side AS sequence, * FROM x_sided UNION ALL SELECT pair || ' both sides', * FROM x_sided UNION ALL SELECT 'sent twice ' || pair, s.* FROM x_sided s, range(2) WHERE offer_side = 'B'
 UNION ALL SELECT pair || ' sides in turn', * REPLACE (CASE WHEN offer_side = 'A' THEN {_LATE} ELSE ts END AS ts) FROM x_sided)) GROUP BY 1""",
)
def v8(t: Tables) -> DataFrame:
    """Every side is a good sequence; beside them bad ones: sides mixed at one time, bars sent twice, and sides in turn, which only their identity gives away."""
    sided = t.sided()
    named = lambda d, name: d.withColumn("sequence", name)
    late = F.when(F.col("offer_side") == "A", F.col("ts") + F.expr("INTERVAL 30 MINUTES")).otherwise(F.col("ts"))
    twice = sided.filter(F.col("offer_side") == "B").withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    every = (
        named(sided, F.concat_ws(" ", "pair", "offer_side"))
        .unionByName(named(sided, F.concat("pair", F.lit(" both sides"))))
        .unionByName(named(twice, F.concat(F.lit("sent twice "), "pair")))
        .unionByName(named(sided.withColumn("ts", late), F.concat("pair", F.lit(" sides in turn"))))
    )
    return quality.sequence_check(every, ["sequence"], month(), SIDE)


@query(
    "v9_strict_order", "user_id:i ordered:b rows:i",
    """SELECT user_id, bool_and(coalesce(gap > 0, true)) AS ordered, count(*) AS rows FROM (SELECT user_id,
 epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) GROUP BY 1""",
)
def v9(t: Tables) -> DataFrame:
    d = t.table("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return quality.sequence_check(d, ["user_id"], time_block("ts", 3600))


@query(
    "v10_leakage_predicate", "safe:b n:i",
    "SELECT n_ts < ts AND (n_pos + 6 < pos) AS safe, count(*) AS n FROM x_nn GROUP BY 1",
)
def v10(t: Tables) -> DataFrame:
    from barline.operators import neighbours

    near = neighbours.nearest(t.states(), neighbours.targets(t.states(), t.study), t.study, t.study.neighbours)
    safe = quality.leakage_free(F.col("n_pos"), F.col("pos"), F.col("n_pos") + t.study.max_horizon + 1)
    return near.groupBy(safe.alias("safe")).agg(F.count(F.lit(1)).alias("n"))


@query("v11_no_future", "pair n:i", "SELECT pair, count(*) AS n FROM x_hbars WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1")
def v11(t: Tables) -> DataFrame:
    return t.hourly().filter(F.col("ts") <= ts("2024-01-15")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query(
    "v13_spread_limit", "pair accepted:i rejected:i",
    """SELECT pair, count(*) FILTER (NOT w) AS accepted, count(*) FILTER (w) AS rejected FROM (SELECT pair,
  ask_close - bid_close > 6.5 * CASE WHEN pair LIKE '%/JPY' THEN 0.001::DOUBLE ELSE 0.00001::DOUBLE END AS w FROM x_hbars) GROUP BY 1""",
)
def v13(t: Tables) -> DataFrame:
    wide = prices.bar_spread() > 6.5 * F.when(F.col("pair").endswith("/JPY"), 0.001).otherwise(0.00001)
    return t.hourly().groupBy("pair").agg(F.count_if(~wide).alias("accepted"), F.count_if(wide).alias("rejected"))


_CLASS = "CASE WHEN pair LIKE '%/JPY' THEN 'FOREX' ELSE 'CRYPTO' END"


@query(
    "v14_series_audit", "pair rows:i bad_ohlc:i max_gap_s:i first_ts:t last_ts:t quality_state reason research_eligible:b",
    f"""SELECT pair, rows, 0 AS bad_ohlc, max_gap_s, first_ts, last_ts,
  CASE WHEN rows < 500 THEN 'INSUFFICIENT_DATA' WHEN max_gap_s > allowed THEN 'FAIL' ELSE 'PASS' END AS quality_state,
  CASE WHEN rows < 500 THEN 'minimum_research_rows_not_met' WHEN max_gap_s > allowed THEN 'unexpected_gap' ELSE 'quality_and_maturity_pass' END AS reason,
  rows >= 500 AND max_gap_s <= allowed AS research_eligible
FROM (SELECT pair, count(*) AS rows, coalesce(max(gap), 0) AS max_gap_s, min(ts) AS first_ts, max(ts) AS last_ts,
   CASE {_CLASS} WHEN 'FOREX' THEN 259200 ELSE 7200 END AS allowed
  FROM (SELECT *, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY pair ORDER BY ts) AS gap FROM x_hbars) GROUP BY pair)""",
)
def v14(t: Tables) -> DataFrame:
    bid = t.sided().filter(F.col("offer_side") == "B")
    kind = F.when(F.col("pair").endswith("/JPY"), "FOREX").otherwise("CRYPTO")
    return quality.series_audit(bid, ["pair"], F.lit(3600), kind, quality.lookup(F.lit("1h"), quality.AUDIT_ROWS), month())


@query(
    "v15_audit_queue", "series:i row_count:i checked_at:t",
    """SELECT user_id AS series, count(*) AS row_count, CASE WHEN user_id % 7 <> 0 THEN max(ts) END AS checked_at FROM events GROUP BY 1
ORDER BY checked_at NULLS FIRST, series LIMIT 25""",
)
def v15(t: Tables) -> DataFrame:
    h = t.table("events").groupBy(F.col("user_id").alias("series")).agg(
        F.count(F.lit(1)).alias("row_count"), F.max(F.col("ts").cast("timestamp")).alias("latest")
    )
    return quality.audit_queue(h.withColumn("checked_at", F.when(F.col("series") % 7 != 0, F.col("latest"))))


fragment("x_latest", """
SELECT user_id, ['FOREX','CRYPTO','METAL','COMMODITY','EQUITY','INDEX'][user_id % 6 + 1] AS asset_class, max(ts) AS latest, user_id % 10 <> 0 AS valid,
  user_id % 11 <> 0 AS contiguous, [300,60,300,3600,86400,86400][user_id % 6 + 1] AS step, [600,180,900,7200,172800,172800][user_id % 6 + 1] AS grace,
  [604800,259200,604800,2678400,31968000,31968000][user_id % 6 + 1] AS backfill FROM events GROUP BY user_id""")


def latest(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(c) for c in ("FOREX", "CRYPTO", "METAL", "COMMODITY", "EQUITY", "INDEX")])
    d = t.table("events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("latest"))
    return d.withColumn("asset_class", F.element_at(kinds, (F.col("user_id") % 6 + 1).cast("int")))


@query(
    "v16_data_health", "user_id:i health reason age_s:i refresh_due:b blocked:b",
    """SELECT user_id, CASE WHEN reason IN ('latest_timestamp_in_future','source_validation_failed','series_not_contiguous') THEN 'BLOCKED'
  WHEN reason = 'within_refresh_interval' THEN 'FRESH' WHEN reason = 'inside_grace_window' THEN 'WATCH' ELSE 'STALE' END AS health, reason, age_s,
  reason NOT IN ('within_refresh_interval','latest_timestamp_in_future') AS refresh_due,
  reason IN ('latest_timestamp_in_future','source_validation_failed','series_not_contiguous') AS blocked
FROM (SELECT *, CASE WHEN age_s < 0 THEN 'latest_timestamp_in_future' WHEN NOT valid THEN 'source_validation_failed' WHEN NOT contiguous THEN 'series_not_contiguous'
  WHEN age_s <= step THEN 'within_refresh_interval' WHEN age_s <= step + grace THEN 'inside_grace_window' ELSE 'refresh_overdue' END AS reason
 FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-30 22:00:00') // 1000000 - epoch_us(latest) // 1000000 AS age_s FROM x_latest))""",
)
def v16(t: Tables) -> DataFrame:
    cols = quality.health(F.col("asset_class"), F.col("latest"), ts("2024-01-30 22:00:00"), F.col("user_id") % 10 != 0, F.col("user_id") % 11 != 0)
    return latest(t).withColumns(cols)


@query(
    "v17_refresh_window", "user_id:i refresh_start:t refresh_end:t",
    """SELECT user_id, least(greatest(latest, n - to_seconds(backfill)), n) AS refresh_start, n AS refresh_end
FROM (SELECT *, TIMESTAMP '2024-01-30 22:00:00' AS n FROM x_latest)""",
)
def v17(t: Tables) -> DataFrame:
    return latest(t).withColumns(quality.refresh_window(F.col("asset_class"), F.col("latest"), ts("2024-01-30 22:00:00")))


_REQ = "CASE asset_class " + " ".join(f"WHEN '{k}' THEN {list(v)!r}" for k, v in REQUIRED_FEATURES.items()) + " END"


@query(
    "v18_missing_context", "user_id:i asset_class missing",
    f"""SELECT l.user_id, asset_class, array_to_string(list_sort(list_filter({_REQ}, lambda x : NOT list_contains(have, x))), ',') AS missing
FROM x_latest l JOIN (SELECT user_id, list(DISTINCT CASE event_type WHEN 'click' THEN 'spread' WHEN 'view' THEN 'trend' WHEN 'purchase' THEN 'volume'
  WHEN 'signup' THEN 'session' ELSE 'momentum' END) AS have FROM events WHERE value > 30 GROUP BY 1) USING (user_id)""",
)
def v18(t: Tables) -> DataFrame:
    feature = quality.lookup(
        F.col("event_type"), {"click": "spread", "view": "trend", "purchase": "volume", "signup": "session"}, "momentum"
    )
    have = t.table("events").filter(F.col("value") > 30).groupBy("user_id").agg(F.collect_set(feature).alias("have"))
    d = latest(t).join(have, "user_id")
    missing = F.array_sort(F.array_except(required_features(F.col("asset_class")), F.col("have")))
    return d.withColumn("missing", F.array_join(missing, ","))


@query(
    "v19_research_contract", "custkey:i asset_class ok:b",
    f"""SELECT c_custkey AS custkey, asset_class, (cal OR asset_class NOT IN {CALENDAR_CLASSES}) AND (vol OR asset_class NOT IN {VOLUME_CLASSES}) AS ok
FROM (SELECT c_custkey, ['FOREX','CRYPTO','METAL','COMMODITY','EQUITY','INDEX'][c_custkey % 6 + 1] AS asset_class, c_acctbal > 0 AS cal, c_nationkey < 15 AS vol FROM customer)""",
)
def v19(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(c) for c in ("FOREX", "CRYPTO", "METAL", "COMMODITY", "EQUITY", "INDEX")])
    d = t.table("customer").withColumn("asset_class", F.element_at(kinds, (F.col("c_custkey") % 6 + 1).cast("int")))
    ok = research_contract_ok(F.col("asset_class"), F.col("c_acctbal") > 0, F.col("c_nationkey") < 15)
    return d.select(F.col("c_custkey").alias("custkey"), "asset_class", ok.alias("ok"))


fragment("x_regime_rows", """
SELECT o_orderkey, o_orderdate AS event_at, o_orderdate - to_days(CAST(o_custkey % 3 AS INT)) AS known_at,
  o_orderdate - to_days(CAST(o_custkey % 3 AS INT)) + to_days(CAST(o_orderkey % 4 AS INT) - 1) AS window_start,
  o_orderdate - to_days(CAST(o_custkey % 3 AS INT)) + to_days(CAST(o_orderkey % 4 AS INT) - 1) + to_days(CAST(o_orderkey % 5 AS INT) - 1) AS window_end,
  o_orderkey % 6 - 1 AS revision FROM orders""")


@query(
    "v20_event_look_ahead", "orderkey:i ok:b",
    """SELECT o_orderkey AS orderkey, known_at <= event_at AND window_start <= window_end AND window_start >= known_at AND revision >= 0 AS ok FROM x_regime_rows""",
)
def v20(t: Tables) -> DataFrame:
    day = lambda c: F.make_dt_interval(c.cast("int"))
    o = t.table("orders").withColumn("event_at", F.col("o_orderdate").cast("timestamp"))
    d = o.withColumn("known_at", F.col("event_at") - day(F.col("o_custkey") % 3))
    d = d.withColumn("window_start", F.col("known_at") + day(F.col("o_orderkey") % 4 - 1))
    d = d.withColumn("window_end", F.col("window_start") + day(F.col("o_orderkey") % 5 - 1)).withColumn("revision", F.col("o_orderkey") % 6 - 1)
    return d.select(F.col("o_orderkey").alias("orderkey"), quality.event_regime_ok().alias("ok"))


@query(
    "v21_record_validation", "pair valid:i invalid:i",
    "SELECT pair, count(*) FILTER (isfinite(agreement) AND isfinite(median_distance) AND isfinite(outcome_pips)) AS valid, 0 AS invalid FROM x_rec GROUP BY 1",
)
def v21(t: Tables) -> DataFrame:
    need = ("pair", "ts", "horizon", "regime", "session", "direction", "split")
    ok = prices.every([F.col(c).isNotNull() for c in need] + [prices.finite(F.col(c)) for c in ("agreement", "median_distance", "outcome_pips")])
    return t.records().groupBy("pair").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query(
    "v22_walk_forward_points", "orderkey:i ok:b",
    """SELECT o_orderkey AS orderkey, a < b AND b < c AND c < d AND d < e AND e < f AS ok FROM (SELECT o_orderkey, o_orderkey AS a, o_orderkey + 10 AS b, o_orderkey + 10 + o_custkey % 3 AS c,
  o_orderkey + 20 AS d, o_orderkey + 30 + o_custkey % 2 AS e, o_orderkey + 31 AS f FROM orders)""",
)
def v22(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = t.table("orders").select(
        k.alias("orderkey"), k.alias("a"), (k + 10).alias("b"), (k + 10 + c % 3).alias("c"), (k + 20).alias("d"), (k + 30 + c % 2).alias("e"), (k + 31).alias("f")
    )
    return d.withColumn("ok", quality.strictly_increasing(["a", "b", "c", "d", "e", "f"]))


@query(
    "v23_stale_runs", "orderkey:i status failure_reason",
    """SELECT o_orderkey AS orderkey, CASE WHEN s AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 180 SECOND THEN 'FAILED' WHEN s THEN 'RUNNING' ELSE 'DONE' END AS status,
  CASE WHEN s AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 180 SECOND THEN 'stale_run_reaped' END AS failure_reason FROM (SELECT *, o_orderstatus = 'O' AS s FROM orders)""",
)
def v23(t: Tables) -> DataFrame:
    runs = t.table("orders").select(
        F.col("o_orderkey").alias("orderkey"), F.when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("DONE").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
    )
    return quality.stale_runs(runs, ts("1998-01-01"))


_ROLL = "pair, offer_side, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume"
_BUCKET = "to_timestamp(0)::TIMESTAMP + to_seconds(CAST(epoch_us(ts) // 1000000 // %d * %d AS BIGINT))"
ROLLED = "pair offer_side ts:t open:d high:d low:d close:d volume:d"


@query(
    "j1_resample", ROLLED,
    f"SELECT {_ROLL}, {_BUCKET % (14400, 14400)} AS b, b AS ts FROM x_sided GROUP BY pair, offer_side, b HAVING count(*) = 4",
)
def j1(t: Tables) -> DataFrame:
    return resample.resample(t.sided(), 3600, 4)


@query(
    "j2_resample_pairs", ROLLED,
    f"SELECT {_ROLL}, {_BUCKET % (7200, 7200)} AS b, b AS ts FROM x_sided GROUP BY pair, offer_side, b HAVING count(*) = 2",
)
def j2(t: Tables) -> DataFrame:
    return resample.resample_pairs(t.sided(), 3600)


@query(
    "j3_resample_on_grid", ROLLED,
    f"SELECT {_ROLL}, {_BUCKET % (7200, 7200)} AS b, b AS ts FROM x_sided GROUP BY pair, offer_side, b HAVING count(*) = 2",
)
def j3(t: Tables) -> DataFrame:
    late = t.sided().withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + 60))
    return resample.resample_on_grid(t.sided().unionByName(late), 3600)


PAIRED = "pair ts:t bid_open:d bid_high:d bid_low:d bid_close:d ask_open:d ask_high:d ask_low:d ask_close:d"


@query("j4_merge_sides", PAIRED, "SELECT * FROM x_hbars WHERE volume > 1")
def j4(t: Tables) -> DataFrame:
    return resample.merge_sides(t.sided().filter((F.col("offer_side") == "B") | (F.col("volume") > 1)))


@query(
    "j5_merge_sides_strict", PAIRED + " spread_open:d spread_close:d",
    "SELECT *, ask_open - bid_open AS spread_open, ask_close - bid_close AS spread_close FROM x_hbars",
)
def j5(t: Tables) -> DataFrame:
    return resample.merge_sides_strict(t.sided())


@query("j6_split_sides", "pair timeframe offer_side ts:t open:d high:d low:d close:d", "SELECT * FROM x_sided")
def j6(t: Tables) -> DataFrame:
    return t.sided()


@query(
    "j7_resolve_instrument", "text pair n:i",
    """SELECT lower(replace(pair, '/', '_')) AS text, pair, count(*) AS n FROM x_hbars GROUP BY 1, 2""",
)
def j7(t: Tables) -> DataFrame:
    asked = t.hourly().select(F.lower(F.regexp_replace("pair", "/", "_")).alias("text"))
    known = t.hourly().select("pair").distinct().withColumn("symbol", labels.normal_symbol("pair", "/_"))
    d = asked.groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("symbol", labels.normal_symbol("text", "/_"))
    return d.join(known, "symbol")


fragment("x_replay", """
SELECT o_orderpriority AS series, o_orderdate AS a0, o_orderdate + to_days(CAST(1 + o_orderkey % 3 AS INT)) AS b0,
  o_orderstatus = 'F' AND o_orderkey % 7 > 0 AND o_custkey % 10 <> 0 AS good FROM orders""")
fragment("x_cover", """
WITH c AS (SELECT series, greatest(a0, TIMESTAMP '1996-01-01') AS a, least(b0, TIMESTAMP '1998-06-01') AS b FROM x_replay WHERE good),
o AS (SELECT series, a, b, max(b) OVER (PARTITION BY series ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c WHERE b > a),
g AS (SELECT series, a, b, sum(CASE WHEN p IS NULL OR a > p THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM o),
m AS (SELECT series, grp, min(a) AS a, max(b) AS b FROM g GROUP BY 1, 2)
SELECT series, sum(epoch_us(b) // 1000000 - epoch_us(a) // 1000000) AS covered_s, count(*) AS complete_windows, min(a) AS covered_from, max(b) AS covered_to,
  epoch_us(TIMESTAMP '1998-06-01') // 1000000 - epoch_us(TIMESTAMP '1996-01-01') // 1000000 AS required_s, greatest(0, required_s - covered_s) AS uncovered_s, covered_s >= required_s AS complete
FROM m GROUP BY series""")
# Equal intervals are one, so that both windows see the same order.
fragment("x_interval_cover", """
WITH c AS (SELECT series, greatest(a0, TIMESTAMP '1996-01-01') AS a, least(b0, TIMESTAMP '1998-06-01') AS b FROM x_replay WHERE good GROUP BY ALL),
o AS (SELECT series, a, b, max(b) OVER (PARTITION BY series ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c WHERE b > a),
g AS (SELECT series, a, b, sum(CASE WHEN p IS NULL OR a > p THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM o),
m AS (SELECT series, grp, min(a) AS a, max(b) AS b FROM g GROUP BY 1, 2)
SELECT series, sum(epoch_us(b) // 1000000 - epoch_us(a) // 1000000) AS covered_s, count(*) AS complete_windows, min(a) AS covered_from, max(b) AS covered_to,
  epoch_us(TIMESTAMP '1998-06-01') // 1000000 - epoch_us(TIMESTAMP '1996-01-01') // 1000000 AS required_s, greatest(0, required_s - covered_s) AS uncovered_s, covered_s >= required_s AS complete
FROM m GROUP BY series""")
COVER = "series covered_s:i complete_windows:i covered_from:t covered_to:t required_s:i uncovered_s:i complete:b"


def replay(t: Tables) -> DataFrame:
    o = t.table("orders")
    start = F.col("o_orderdate").cast("timestamp")
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return o.select(
        F.col("o_orderpriority").alias("series"), start.alias("requested_from"),
        (start + F.make_dt_interval((1 + F.col("o_orderkey") % 3).cast("int"))).alias("requested_to"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETE").otherwise("PARTIAL").alias("continuity_state"),
        (F.col("o_orderkey") % 7).alias("received_rows"), digest.alias("source_hash"),
        F.when(F.col("o_custkey") % 10 != 0, digest).otherwise("short").alias("evidence_hash"),
    )


def covered(t: Tables) -> DataFrame:
    required = replay(t).select("series").distinct().select(
        "series", ts("1996-01-01").alias("required_from"), ts("1998-06-01").alias("required_to")
    )
    return intervals.coverage(replay(t), required)


@query("j12_interval_coverage", COVER, "SELECT * FROM x_interval_cover")
def j12(t: Tables) -> DataFrame:
    return covered(t)


@query("j13_coverage_refresh", COVER, "SELECT * FROM x_cover")
def j13(t: Tables) -> DataFrame:
    from barline.catalog.sources import scratch
    from barline.sources.store import refresh_derived

    path = scratch(t, "coverage")
    half = F.pmod(F.xxhash64("series"), F.lit(2)) == 0
    refresh_derived(t.spark, path, covered(t).withColumn("covered_s", F.lit(0).cast("bigint")), ["series"])
    refresh_derived(t.spark, path, covered(t).filter(half), ["series"])
    return refresh_derived(t.spark, path, covered(t).filter(~half), ["series"])


fragment("x_plan_series", """
SELECT c_custkey AS series, CASE c_nationkey % 3 WHEN 0 THEN 'DUKASCOPY' WHEN 1 THEN 'BINANCE' ELSE 'OTHER' END AS provider,
  ['1m','1s','1h','1d'][c_custkey % 4 + 1] AS timeframe, CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY','AUTOMOBILE') THEN 'DIRECT' ELSE 'DERIVED' END AS generation_mode,
  c_acctbal > 0 AS enabled, c_acctbal > 8000 AS research_eligible, CASE WHEN c_custkey % 5 > 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 900 AS INT)) END AS cursor_at FROM customer""")
fragment("x_plan_next", """
SELECT *, least(window_from + CASE WHEN provider = 'DUKASCOPY' THEN INTERVAL 31 DAY WHEN timeframe = '1m' THEN INTERVAL 3 DAY WHEN timeframe = '1s' THEN INTERVAL 30 MINUTE ELSE INTERVAL 1 DAY END,
  TIMESTAMP '2026-06-01') AS window_to FROM (SELECT *, coalesce(cursor_at, CASE WHEN provider = 'DUKASCOPY' THEN TIMESTAMP '2020-01-01' WHEN timeframe = '1s' THEN TIMESTAMP '2026-08-22'
  ELSE TIMESTAMP '2026-03-01' END) AS window_from FROM x_plan_series) WHERE window_from < TIMESTAMP '2026-06-01'""")


@query(
    "j14_backfill_windows", "series:i window_from:t window_to:t",
    """SELECT * FROM x_plan_next WHERE enabled AND NOT research_eligible AND generation_mode = 'DIRECT' AND provider IN ('DUKASCOPY','BINANCE') AND series % 7 <> 0
ORDER BY cursor_at NULLS FIRST, series LIMIT 66""",
)
def j14(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    series = t.table("customer").select(
        key.alias("series"),
        F.when(F.col("c_nationkey") % 3 == 0, "DUKASCOPY").when(F.col("c_nationkey") % 3 == 1, "BINANCE").otherwise("OTHER").alias("provider"),
        F.element_at(F.array(*[F.lit(x) for x in ("1m", "1s", "1h", "1d")]), (key % 4 + 1).cast("int")).alias("timeframe"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE"), "DIRECT").otherwise("DERIVED").alias("generation_mode"),
        (F.col("c_acctbal") > 0).alias("enabled"), (F.col("c_acctbal") > 8000).alias("research_eligible"),
        F.when(key % 5 > 0, ts("2024-01-01") + F.make_dt_interval((key % 900).cast("int"))).alias("cursor_at"),
        F.lit(None).cast("timestamp").alias("target_at"),
    )
    now = ts("2026-06-01")
    none = t.spark.createDataFrame([], "series bigint, window_from timestamp, window_to timestamp")
    planned = intervals.next_windows(series, none, now, limit=2**31 - 1).filter(F.col("series") % 7 == 0)
    return intervals.next_windows(series, planned, now)


@query(
    "j15_blocked_without_direct", "nationkey:i state reason",
    """SELECT n_nationkey AS nationkey, CASE WHEN d THEN 'OK' ELSE 'BLOCKED' END AS state, CASE WHEN d THEN NULL ELSE 'provider_replay_required_raw_storage_disabled' END AS reason
FROM (SELECT n_nationkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9500 AND c_mktsegment = 'BUILDING') AS d FROM nation)""",
)
def j15(t: Tables) -> DataFrame:
    direct = t.table("customer").filter((F.col("c_acctbal") > 9500) & (F.col("c_mktsegment") == "BUILDING"))
    health = t.table("nation").select(F.col("n_nationkey").alias("nationkey"), F.lit("OK").alias("state"), F.lit(None).cast("string").alias("reason"))
    key = direct.select(F.col("c_nationkey").alias("nationkey"))
    blocked = health.join(key, "nationkey", "left_anti").select(
        "nationkey", F.lit("BLOCKED").alias("state"), F.lit("provider_replay_required_raw_storage_disabled").alias("reason")
    )
    return health.join(key, "nationkey", "left_semi").unionByName(blocked)


@query(
    "j16_regime_containment", "nationkey:i n:i",
    """SELECT n_nationkey AS nationkey, count(*) AS n FROM lineitem JOIN nation ON l_shipdate >= TIMESTAMP '1996-01-01' + to_days(n_nationkey * 30)
  AND l_shipdate <= TIMESTAMP '1996-01-01' + to_days(n_nationkey * 30 + 20) GROUP BY 1""",
)
def j16(t: Tables) -> DataFrame:
    start = ts("1996-01-01") + F.make_dt_interval((F.col("n_nationkey") * 30).cast("int"))
    regimes = t.table("nation").select(
        F.col("n_nationkey").alias("nationkey"), start.alias("window_start"), (start + F.make_dt_interval(F.lit(20))).alias("window_end")
    )
    points = t.table("lineitem").select(F.col("l_shipdate").cast("timestamp").alias("at"))
    return intervals.contained(points, regimes, "at", "window_start", "window_end", 30 * DAYS).groupBy("nationkey").agg(F.count(F.lit(1)).alias("n"))
