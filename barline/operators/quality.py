"""Integrity, audit, health and planning over bar series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.prices import geometry_ok
from barline.operators.ordering import in_blocks, with_positions

# Seconds between bars of the timeframes whose gaps are counted.
INTERVALS = {"10sec": 10, "1min": 60, "10m": 600, "1hour": 3600, "1day": 86400, "1day_eet": 86400}

# Refresh interval, grace and longest backfill in seconds, by asset class.
POLICIES = {
    "FOREX": (300, 600, 604800),
    "CRYPTO": (60, 180, 259200),
    "METAL": (300, 900, 604800),
    "METALS": (300, 900, 604800),
    "ENERGY": (300, 900, 604800),
    "COMMODITY": (3600, 7200, 2678400),
    "EQUITY": (86400, 172800, 31968000),
    "INDEX": (86400, 172800, 31968000),
}

# Seconds per step of the audited timeframes, and rows needed before research.
AUDIT_STEPS = {"1s": 1, "1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
AUDIT_ROWS = {"1s": 10000, "1m": 5000, "5m": 1000, "15m": 1000, "1h": 500, "4h": 500, "1d": 200}


def lookup(key: Column, table: dict[str, int | str], default: object = None) -> Column:
    """A fixed table as a chain of conditions."""
    out: Column | None = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(F.lit(default))


def gaps(bars: DataFrame, keys: Sequence[str], block: Column, ts: str = "ts", block_rows: int = 4096) -> DataFrame:
    """Each row with the seconds since the previous row of its series."""
    d = with_positions(bars, keys, [ts], block)

    def compute(x: DataFrame, window) -> DataFrame:  # noqa: ANN001
        return x.withColumn("gap_s", F.unix_seconds(ts) - F.unix_seconds(F.lag(ts).over(window())))

    return in_blocks(d, keys, "pos", 1, 0, compute, block_rows)


def integrity(bars: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Rows, order, duplicates, bad spans and missing bars per series."""
    d = gaps(bars, keys, block)
    step = lookup(F.col("timeframe"), INTERVALS)
    missing = F.when(F.col("gap_s") > step, F.greatest(F.lit(1), F.floor(F.col("gap_s") / step) - 1)).otherwise(0)
    r = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("gap_s") == 0).alias("duplicates"),
        F.count_if(~geometry_ok()).alias("invalid_spans"),
        F.sum(missing).alias("missing"),
    )
    r = r.withColumn("strictly_increasing", F.col("duplicates") == 0)
    return r.withColumn("ok", (F.col("rows") > 0) & F.col("strictly_increasing") & (F.col("invalid_spans") == 0))


def contract_violations(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """Bars that break the request of their feed, with the reasons; ``feed`` names the request."""
    r = requests.select("feed", *[F.col(c).alias(f"want_{c}") for c in ("pair", "timeframe", "offer_side", "start", "end")])
    twice = bars.groupBy("feed", "ts").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    d = bars.join(r, "feed").join(twice, ["feed", "ts"], "left")
    reasons = F.array(
        F.when(F.col("pair") != F.col("want_pair"), "unexpected instrument"),
        F.when(F.col("timeframe") != F.col("want_timeframe"), "unexpected timeframe"),
        F.when(F.col("offer_side") != F.col("want_offer_side"), "unexpected offer side"),
        F.when((F.col("ts") < F.col("want_start")) | (F.col("ts") >= F.col("want_end")), "outside the requested interval"),
        F.when(F.col("_n") > 1, "duplicate timestamps"),
    )
    return d.withColumn("reasons", F.array_compact(reasons)).filter(F.size("reasons") > 0)


def sequence_check(bars: DataFrame, keys: Sequence[str], block: Column, identity: Sequence[str] = ()) -> DataFrame:
    """Strictly increasing times and one identity (instrument, timeframe, side) per sequence."""
    who = F.struct(*identity) if identity else F.lit(True)
    return gaps(bars, keys, block).groupBy(*keys).agg(
        F.bool_and(F.coalesce(F.col("gap_s") > 0, F.lit(True))).alias("ordered"), (F.min(who) == F.max(who)).alias("one_identity"), F.count(F.lit(1)).alias("rows")
    ).withColumn("valid", F.col("ordered") & F.col("one_identity"))


def leakage_free(feature_time: Column, observation: Column, outcome_end: Column) -> Column:
    """Features are known before the observation and the outcome ends by then."""
    return (feature_time < observation) & (outcome_end <= observation)


def series_audit(
    bars: DataFrame, keys: Sequence[str], step_s: Column, asset_class: Column, min_rows: Column, block: Column, newest: int | None = None
) -> DataFrame:
    """Quality verdict per series over all its rows, or its ``newest`` ones where a caller asks; gaps are taken before the cut."""
    d = gaps(bars, keys, block)
    if newest is not None:
        total = d.groupBy(*keys).agg(F.max("pos").alias("_last"))
        d = d.join(total, list(keys)).filter(F.col("pos") > F.col("_last") - newest)
    r = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~geometry_ok()).alias("bad_ohlc"),
        F.coalesce(F.max("gap_s"), F.lit(0)).alias("max_gap_s"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    kind = F.upper(asset_class)
    allowed = (
        F.when(kind.isin("FOREX", "METAL", "COMMODITY"), F.greatest(step_s * 3, F.lit(259200)))
        .when(kind.isin("EQUITY", "INDEX"), F.greatest(step_s * 3, F.lit(604800)))
        .otherwise(step_s * 2)
    )
    reason = (
        F.when(F.col("rows") == 0, "no_rows")
        .when(F.col("rows") < min_rows, "minimum_research_rows_not_met")
        .when(F.col("bad_ohlc") > 0, "invalid_ohlc")
        .when(F.col("max_gap_s") > allowed, "unexpected_gap")
        .otherwise("quality_and_maturity_pass")
    )
    r = r.withColumn("reason", reason)
    state = (
        F.when(F.col("reason").isin("no_rows", "minimum_research_rows_not_met"), "INSUFFICIENT_DATA")
        .when(F.col("reason") == "quality_and_maturity_pass", "PASS")
        .otherwise("FAIL")
    )
    return r.withColumn("quality_state", state).withColumn("research_eligible", F.col("quality_state") == "PASS")


def audit_queue(health: DataFrame, limit: int = 25) -> DataFrame:
    """Series to audit next: never or longest ago checked first; the limit stays within 1 to 100."""
    n = max(1, min(limit, 100))
    return health.filter(F.col("row_count") > 0).orderBy(F.col("checked_at").asc_nulls_first(), "series").limit(n)


def _policy(asset_class: Column, part: int) -> Column:
    return lookup(F.upper(F.trim(asset_class)), {k: v[part] for k, v in POLICIES.items()})


def health(asset_class: Column, latest: Column, now: Column, source_valid: Column, contiguous: Column) -> dict[str, Column]:
    """Data health of a series with its reason; fails closed before age is looked at."""
    age = F.unix_seconds(now) - F.unix_seconds(latest)
    interval, grace = _policy(asset_class, 0), _policy(asset_class, 1)
    reason = (
        F.when(latest.isNull(), "missing_latest_timestamp")
        .when(age < 0, "latest_timestamp_in_future")
        .when(~source_valid, "source_validation_failed")
        .when(~contiguous, "series_not_contiguous")
        .when(age <= interval, "within_refresh_interval")
        .when(age <= interval + grace, "inside_grace_window")
        .otherwise("refresh_overdue")
    )
    state = (
        F.when(reason == "within_refresh_interval", "FRESH")
        .when(reason == "inside_grace_window", "WATCH")
        .when(reason == "refresh_overdue", "STALE")
        .otherwise("BLOCKED")
    )
    due = ~reason.isin("within_refresh_interval", "latest_timestamp_in_future")
    return {"health": state, "reason": reason, "age_s": age, "refresh_due": due, "blocked": state == "BLOCKED"}


def refresh_window(asset_class: Column, latest: Column, now: Column) -> dict[str, Column]:
    """What to fetch next: from the latest bar, but no further back than the policy allows."""
    oldest = F.timestamp_seconds(F.unix_seconds(now) - _policy(asset_class, 2))
    start = F.least(F.greatest(latest, oldest), now)
    return {"refresh_start": start, "refresh_end": now}


def stale_runs(runs: DataFrame, now: Column, max_age_s: int = 180) -> DataFrame:
    """Runs still RUNNING after the age limit become FAILED."""
    stale = (F.col("status") == "RUNNING") & (F.unix_seconds("started_at") < F.unix_seconds(now) - max_age_s)
    return (
        runs.withColumn("_stale", stale)
        .withColumn("status", F.when(F.col("_stale"), "FAILED").otherwise(F.col("status")))
        .withColumn("failure_reason", F.when(F.col("_stale"), "stale_run_reaped"))
        .drop("_stale")
    )


def event_regime_ok() -> Column:
    """Known no later than the event; the window is ordered and starts once it is known; revision is not negative."""
    return (
        (F.col("known_at") <= F.col("event_at"))
        & (F.col("window_start") <= F.col("window_end"))
        & (F.col("window_start") >= F.col("known_at"))
        & (F.col("revision") >= 0)
    )


def strictly_increasing(points: Sequence[str]) -> Column:
    """Every point lies after the one before it."""
    out = F.lit(True)
    for a, b in zip(points, points[1:]):
        out = out & (F.col(a) < F.col(b))
    return out
