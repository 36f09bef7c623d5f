"""Interval coverage, replay planning and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators.ordering import prefix
from barline.session import small_side


def evidence_ok() -> Column:
    return (
        (F.col("continuity_state") == "COMPLETE")
        & (F.col("requested_to") > F.col("requested_from"))
        & (F.col("received_rows") > 0)
        & (F.length("source_hash") == 64)
        & (F.length("evidence_hash") == 64)
    )


def merged_intervals(rows: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b", block_s: int = 31 * 86400) -> DataFrame:
    """Merge overlapping or touching intervals per key.

    The latest end so far and the run number are two-level prefixes over time blocks, so a key with a
    third of the intervals is still spread over many tasks.
    """
    block = F.floor(F.unix_seconds(F.col(a)) / F.lit(block_s)).cast("bigint")
    d = rows.groupBy(*keys, a).agg(F.max(b).alias(b))
    d = prefix(d, keys, [a], block, "prior_end", F.col(b), how="max", inclusive=False)
    starts = (F.col("prior_end").isNull() | (F.col(a) > F.col("prior_end"))).cast("bigint")
    d = prefix(d, keys, [a], block, "grp", starts)
    return d.groupBy(*keys, "grp").agg(F.min(a).alias(a), F.max(b).alias(b)).drop("grp")


def coverage(evidence: DataFrame, required: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Covered and uncovered seconds of each required range; ``required`` has required_from / required_to per key."""
    good = evidence.filter(evidence_ok()).join(required, list(keys))
    clipped = good.select(
        *keys,
        F.greatest("requested_from", "required_from").alias("a"),
        F.least("requested_to", "required_to").alias("b"),
    ).filter(F.col("b") > F.col("a"))
    merged = merged_intervals(clipped, keys)
    seconds = F.unix_seconds("b") - F.unix_seconds("a")
    stats = merged.groupBy(*keys).agg(
        F.sum(seconds).alias("covered_s"), F.count(F.lit(1)).alias("complete_windows"),
        F.min("a").alias("covered_from"), F.max("b").alias("covered_to"),
    )
    need = F.greatest(F.lit(0), F.unix_seconds("required_to") - F.unix_seconds("required_from"))
    d = required.join(stats, list(keys), "left").withColumn("required_s", need)
    d = d.withColumn("covered_s", F.coalesce("covered_s", F.lit(0))).withColumn(
        "complete_windows", F.coalesce("complete_windows", F.lit(0))
    )
    return d.withColumn("uncovered_s", F.greatest(F.lit(0), F.col("required_s") - F.col("covered_s"))).withColumn(
        "complete", F.col("covered_s") >= F.col("required_s")
    )


def next_windows(series: DataFrame, existing: DataFrame, now: Column, limit: int = 66) -> DataFrame:
    """One next backfill chunk per eligible series, unless that window is already planned."""
    # First day and chunk length by provider and timeframe.
    far = F.lit("2020-01-01").cast("timestamp")
    near = F.lit("2026-03-01").cast("timestamp")
    second = F.lit("2026-08-22").cast("timestamp")
    slow = F.col("provider") == "DUKASCOPY"
    first = F.when(slow, far).when(F.col("timeframe") == "1s", second).otherwise(near)
    chunk_s = (
        F.when(slow, 31 * 86400).when(F.col("timeframe") == "1m", 3 * 86400).when(F.col("timeframe") == "1s", 1800).otherwise(86400)
    )
    d = series.filter(
        F.col("enabled")
        & (F.col("generation_mode") == "DIRECT")
        & F.col("provider").isin("BINANCE", "DUKASCOPY")
        & ~F.coalesce(F.col("research_eligible"), F.lit(False))
    )
    d = d.withColumn("window_from", F.coalesce("cursor_at", first)).withColumn("_target", F.coalesce("target_at", now))
    d = d.filter(F.col("window_from") < F.col("_target")).withColumn(
        "window_to", F.least(F.timestamp_seconds(F.unix_seconds("window_from") + chunk_s), F.col("_target"))
    )
    planned = existing.select("series", "window_from", "window_to")
    return (
        d.join(planned, ["series", "window_from", "window_to"], "left_anti")
        .orderBy(F.col("cursor_at").asc_nulls_first(), "series")
        .limit(limit)
    )


def contained(points: DataFrame, intervals: DataFrame, ts: str, start: str, end: str, block_s: int) -> DataFrame:
    """Points inside closed intervals: an equi-join on time blocks with the exact test behind it."""
    block = lambda c: F.floor(F.unix_seconds(c) / F.lit(block_s)).cast("bigint")
    p = points.withColumn("_blk", block(F.col(ts)))
    i = intervals.withColumn("_blk", F.explode(F.sequence(block(F.col(start)), block(F.col(end)))))
    return p.join(small_side(i), "_blk").filter((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))).drop("_blk")
