"""Ordered profit paths: drawdown, chronological folds, transitions, lagged correlation, walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.labels import col
from barline.functions.statistics import pearson
from barline.operators.ordering import in_blocks, time_block, with_positions

WEEK = 7 * 86400


def drawdown(df: DataFrame, keys: Sequence[str], value: str | Column, order: Sequence[str] = ("ts", "pair"), block: Column | None = None) -> DataFrame:
    """Largest fall of the cumulated value below its peak (which starts at 0), per group.

    Each block gives its total, highest and lowest running sum and own drawdown; blocks are then
    chained, one row each.  The rows are shuffled once and no task holds a whole group.
    """
    keys = list(keys)
    block = time_block("ts", WEEK) if block is None else block
    d = df.select(*keys, *order, block.alias("_b"), col(value).cast("double").alias("_v"))
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_cum", F.sum("_v").over(w)).withColumn("_peak", F.max("_cum").over(w))
    blocks = d.groupBy(*keys, "_b").agg(
        F.sum("_v").alias("_total"), F.max("_cum").alias("_high"), F.min("_cum").alias("_low"), F.max(F.col("_peak") - F.col("_cum")).alias("_own")
    )
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
    blocks = blocks.withColumn("_before", F.greatest(F.lit(0.0), F.max(F.col("_off") + F.col("_high")).over(earlier)))
    fall = F.greatest(F.col("_own"), F.col("_before") - F.col("_off") - F.col("_low"))
    return blocks.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max(fall)).alias("max_drawdown"), F.sum("_total").alias("net_profit"))


def recovery(net_profit: Column, max_drawdown: Column) -> Column:
    """Net profit over drawdown; infinite for a gain without a drawdown, 0 for none of both."""
    return (
        F.when((max_drawdown == 0) & (net_profit > 0), F.lit(float("inf")))
        .when(max_drawdown > 0, net_profit / max_drawdown)
        .otherwise(0.0)
    )


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "pair"), block: Column | None = None) -> DataFrame:
    """0-based ``rn`` inside the group and the group size ``n``."""
    return with_positions(df, keys, list(order), time_block("ts", WEEK) if block is None else block, out="rn", total="n")


def equal_folds(df: DataFrame, keys: Sequence[str], folds: int, order: Sequence[str] = ("ts", "pair")) -> DataFrame:
    """Chronological folds of floor(n/folds) rows; the last takes the remainder.  Smaller groups have none."""
    d = ranked(df, keys, order).filter(F.col("n") >= folds)
    return d.withColumn("fold", F.least(F.floor(F.col("rn") / F.floor(F.col("n") / folds)), F.lit(folds - 1)).cast("bigint"))


def halves(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "pair")) -> DataFrame:
    """First floor(n/2) rows of the group, and the rest."""
    d = ranked(df, keys, order)
    return d.withColumn("half", F.when(F.col("rn") < F.floor(F.col("n") / 2), 1).otherwise(2))


def index_folds(groups: DataFrame, total: str, train: int, validation: int, step: int) -> DataFrame:
    """Sliding train/validation index folds for each row's ``total`` observations."""
    last = F.col(total) - train - validation
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    d = groups.withColumn("train_start", F.explode(starts))
    d = d.withColumns(
        {
            "train_end": F.col("train_start") + train - 1,
            "validation_start": F.col("train_start") + train,
            "validation_end": F.col("train_start") + train + validation - 1,
        }
    )
    return d.withColumn("leakage_free", F.col("train_end") < F.col("validation_start"))


def expanding_folds(df: DataFrame, keys: Sequence[str], train_s: int, test_s: int, step_s: int | None = None, purge_s: int = 0) -> DataFrame:
    """Expanding time folds: all up to ``train_end``, then a purge, then the test window."""
    span = df.groupBy(*keys).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    step = step_s or test_s
    first, last = F.unix_seconds("first_ts") + train_s, F.unix_seconds("last_ts") - purge_s - test_s
    ends = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    d = span.withColumn("_end", F.explode(ends))
    return d.select(
        *keys,
        F.col("first_ts").alias("train_start"),
        F.timestamp_seconds("_end").alias("train_end"),
        F.timestamp_seconds(F.col("_end") + purge_s).alias("test_start"),
        F.timestamp_seconds(F.col("_end") + purge_s + test_s).alias("test_end"),
    )


def purged_boundaries(timeline: DataFrame, folds: int, interval_s: int) -> DataFrame:
    """``folds`` chronological runs over the distinct times: starts at index n*i/folds; the last run is open.

    Distinct times are counted per day; only the day counts are ordered together.
    """
    d = timeline.select("ts").distinct().withColumn("_one", F.lit(0))
    d = with_positions(d, ["_one"], ["ts"], time_block("ts", 86400), out="idx", total="n").filter(F.col("n") >= folds)
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    starts = d.filter(F.col("idx") == F.floor(F.col("n") * F.col("fold") / folds)).select("fold", F.col("ts").alias("start"))
    w = Window.orderBy("fold")
    return starts.withColumn("end", F.lead("start").over(w))


def purged_folds(records: DataFrame, boundaries: DataFrame, interval_s: int) -> DataFrame:
    """Records of each run with the reason they are left out, if any.

    The first ``horizon`` bars of a run and outcomes not ending before the next run are purged.
    The boundary table holds one row per run, so it is broadcast.
    """
    end_of = lambda s: F.timestamp_seconds(F.unix_seconds("ts") + F.col("horizon") * s)
    inside = (F.col("ts") >= F.col("start")) & (F.col("end").isNull() | (F.col("ts") < F.col("end")))
    d = records.join(F.broadcast(boundaries), inside)
    opened = F.timestamp_seconds(F.unix_seconds("start") + F.col("horizon") * interval_s)
    state = (
        F.when(F.col("ts") < opened, "purged_start")
        .when(F.col("end").isNotNull() & (end_of(interval_s) >= F.col("end")), "purged_end")
        .otherwise("kept")
    )
    return d.withColumn("purge", state)


def transitions(df: DataFrame, keys: Sequence[str], state: str, value: str) -> DataFrame:
    """State to next state: count, share of its origin, and mean value at the next row."""
    d = with_positions(df, keys, ["ts"], time_block("ts", WEEK))

    def compute(x: DataFrame, window) -> DataFrame:  # noqa: ANN001
        return x.withColumn("to_state", F.lead(state).over(window())).withColumn("_next", F.lead(value).over(window()))

    d = in_blocks(d, keys, "pos", 0, 1, compute).filter(F.col("to_state").isNotNull())
    n = d.groupBy(*keys, F.col(state).alias("from_state"), "to_state").agg(
        F.count(F.lit(1)).alias("observations"), F.avg("_next").alias("mean_outcome")
    )
    whole = F.sum("observations").over(Window.partitionBy(*keys, "from_state"))
    return n.withColumn("probability", F.col("observations") / whole)


def aligned_pairs(df: DataFrame, on: Sequence[str], member: str, value: str) -> DataFrame:
    """Values of every two members at the same ``on`` key.  A key holds at most one row per member."""
    a = df.select(*on, F.col(member).alias("pair_a"), F.col(value).alias("value_a"))
    b = df.select(*on, F.col(member).alias("pair_b"), F.col(value).alias("value_b"))
    return a.join(b, list(on)).filter(F.col("pair_a") < F.col("pair_b"))


def lagged_correlation(aligned: DataFrame, keys: Sequence[str], max_lag: int = 5, least: int = 20) -> DataFrame:
    """Correlation of the aligned series at every lag in -max_lag..max_lag, for groups of ``least`` or more points.

    A positive lag pairs a value of a with a later value of b.  The neighbours come from one
    window over position blocks; nothing is joined.
    """
    d = with_positions(aligned, keys, ["ts"], time_block("ts", WEEK), total="points").filter(F.col("points") >= least)

    def compute(x: DataFrame, window) -> DataFrame:  # noqa: ANN001
        lags = [
            F.struct(F.lit(k).alias("lag"), (F.lead("value_b", k) if k >= 0 else F.lag("value_b", -k)).over(window()).alias("b"))
            for k in range(-max_lag, max_lag + 1)
        ]
        return x.withColumn("_lags", F.array(*lags))

    d = in_blocks(d, keys, "pos", max_lag, max_lag, compute)
    d = d.select(*keys, "points", "value_a", F.explode("_lags").alias("l")).filter(F.col("l.b").isNotNull())
    return d.groupBy(*keys, "points", F.col("l.lag").alias("lag")).agg(
        pearson("value_a", "l.b").alias("correlation"), F.count(F.lit(1)).alias("observations")
    )


def strongest_lag(lagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zero-lag correlation and the lag with the largest absolute one (the first lag wins a tie)."""
    return lagged.groupBy(*keys, "points").agg(
        F.max(F.when(F.col("lag") == 0, F.col("correlation"))).alias("zero_lag"),
        F.max_by(F.struct("lag", "correlation"), F.struct(F.abs("correlation"), -F.col("lag"))).alias("_s"),
    ).select(*keys, "points", "zero_lag", F.col("_s.lag").alias("strongest_lag"), F.col("_s.correlation").alias("strongest"))
