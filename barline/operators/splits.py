"""Chronological discovery/confirmation splits with purging at the boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISCOVERY_SHARE = 0.6


def quantile_time(df: DataFrame, keys: Sequence[str], ts: str, fraction: float, distinct: bool) -> DataFrame:
    """The time at index int(fraction*n) of the sorted times, per ``keys`` (none: one row).

    Times are counted per value, then per day; only the day counts are summed in order, and the
    index is looked up inside its day.  No sort of all rows in one task.
    """
    keys = list(keys)
    per_ts = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_c"))
    per_ts = per_ts.withColumn("_c", F.lit(1).cast("bigint")) if distinct else per_ts
    per_ts = per_ts.withColumn("_day", F.to_date(ts))
    day = per_ts.groupBy(*keys, "_day").agg(F.sum("_c").alias("_d"))
    order = Window.partitionBy(*keys).orderBy("_day")
    day = day.select(
        *keys,
        "_day",
        (F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_d")).alias("_before"),
        F.floor(F.sum("_d").over(Window.partitionBy(*keys)) * F.lit(float(fraction))).alias("_idx"),
    )
    inner = Window.partitionBy(*keys, "_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    ranked = per_ts.join(day, [*keys, "_day"]).withColumn("_cum", F.col("_before") + F.sum("_c").over(inner))
    return ranked.filter((F.col("_cum") > F.col("_idx")) & (F.col("_cum") - F.col("_c") <= F.col("_idx"))).select(
        *keys, F.col(ts).alias("cutoff")
    )


def split_label(ts: Column, end: Column, cutoff: Column) -> Column:
    """Confirmation from the cutoff on; discovery if the outcome ends before it; else purged."""
    return F.when(cutoff.isNull() | (ts >= cutoff), "confirmation").when(end < cutoff, "discovery").otherwise("purged_boundary")


def with_global_split(records: DataFrame, fraction: float = DISCOVERY_SHARE, out: str = "global_split") -> DataFrame:
    """One cutoff over all records, times counted with duplicates, as a scalar subquery."""
    cutoff = quantile_time(records, [], "ts", fraction, distinct=False)
    return records.withColumn(out, split_label(F.col("ts"), F.col("target_end"), cutoff.scalar()))


def with_pair_split(records: DataFrame, interval_s: int, fraction: float = DISCOVERY_SHARE, out: str = "split") -> DataFrame:
    """A cutoff per pair over its distinct times; the outcome end is horizon x interval after the target."""
    cutoff = quantile_time(records, ["pair"], "ts", fraction, distinct=True)
    end = F.timestamp_seconds(F.unix_seconds("ts") + F.col("horizon") * interval_s)
    return (
        records.join(cutoff, ["pair"], "left")
        .withColumn(out, split_label(F.col("ts"), end, F.col("cutoff")))
        .drop("cutoff")
    )
