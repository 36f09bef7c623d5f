"""Forward outcomes over paired bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators.ordering import in_blocks
from barline.session import Study


def forward_columns(window: Callable[..., object], h: int) -> dict[str, Column]:
    """Exit price, best high and worst low of both sides over the next ``h`` bars (fewer at the end)."""
    w = window(1, h)
    return {
        f"exit_bid_{h}": F.last("bid_close").over(w),
        f"exit_ask_{h}": F.last("ask_close").over(w),
        f"top_bid_{h}": F.max("bid_high").over(w),
        f"low_bid_{h}": F.min("bid_low").over(w),
        f"top_ask_{h}": F.max("ask_high").over(w),
        f"low_ask_{h}": F.min("ask_low").over(w),
    }


def long_move(h: int) -> Column:
    return F.col(f"exit_bid_{h}") - F.col("ask_close")


def short_move(h: int) -> Column:
    return F.col("bid_close") - F.col(f"exit_ask_{h}")


def outcomes(bars: DataFrame, study: Study, full_only: bool = False) -> DataFrame:
    """One row per bar, horizon and direction; ``full_only`` drops horizons cut by the end of the series."""

    def compute(d: DataFrame, window: Callable[..., object]) -> DataFrame:
        for h in study.horizons:
            d = d.withColumns(forward_columns(window, h))
        return d

    wide = in_blocks(bars, ["pair"], "pos", 0, study.max_horizon, compute, study.block_rows)
    rows = []
    for h in study.horizons:
        rows.append(
            F.struct(
                F.lit(h).cast("bigint").alias("horizon"),
                F.lit("long").alias("direction"),
                F.col("ask_close").alias("entry"),
                F.col(f"exit_bid_{h}").alias("exit"),
                long_move(h).alias("move"),
                (F.col(f"top_bid_{h}") - F.col("ask_close")).alias("mfe"),
                (F.col("ask_close") - F.col(f"low_bid_{h}")).alias("mae"),
            )
        )
        rows.append(
            F.struct(
                F.lit(h).cast("bigint").alias("horizon"),
                F.lit("short").alias("direction"),
                F.col("bid_close").alias("entry"),
                F.col(f"exit_ask_{h}").alias("exit"),
                short_move(h).alias("move"),
                (F.col("bid_close") - F.col(f"low_ask_{h}")).alias("mfe"),
                (F.col(f"top_ask_{h}") - F.col("bid_close")).alias("mae"),
            )
        )
    out = wide.select("pair", "ts", "pos", "bars", F.explode(F.array(*rows)).alias("o"))
    out = out.select("pair", "ts", "pos", "bars", "o.*").filter(F.col("exit").isNotNull())
    return out.filter(F.col("pos") + F.col("horizon") < F.col("bars")) if full_only else out


def first_touch(bars: DataFrame, study: Study, h: int, target: Column, stop: Column) -> DataFrame:
    """Which barrier is reached first within ``h`` bars, per bar and direction.

    ``hit`` is true for the target, false for the stop, null if neither or both in the same bar.
    The array of the next ``h`` bars has a fixed size, so the row stays bounded.
    """

    def compute(d: DataFrame, window: Callable[..., object]) -> DataFrame:
        ahead = F.struct("bid_high", "bid_low", "ask_high", "ask_low")
        return d.withColumn("_next", F.collect_list(ahead).over(window(1, h)))

    d = in_blocks(bars, ["pair"], "pos", 0, h, compute, study.block_rows).filter(F.size("_next") > 0)
    d = d.withColumn("target", target).withColumn("stop", stop)

    def decide(reached: Callable[[Column], Column], stopped: Callable[[Column], Column]) -> Column:
        touched = F.filter("_next", lambda b: reached(b) | stopped(b))
        first = F.get(touched, F.lit(0))
        return F.when(F.size(touched) == 0, None).when(reached(first) & stopped(first), None).otherwise(reached(first))

    long_hit = decide(
        lambda b: b["bid_high"] >= F.col("ask_close") + F.col("target"),
        lambda b: b["bid_low"] <= F.col("ask_close") - F.col("stop"),
    )
    short_hit = decide(
        lambda b: b["ask_low"] <= F.col("bid_close") - F.col("target"),
        lambda b: b["ask_high"] >= F.col("bid_close") + F.col("stop"),
    )
    both = F.array(
        F.struct(F.lit("long").alias("direction"), long_hit.alias("hit")),
        F.struct(F.lit("short").alias("direction"), short_hit.alias("hit")),
    )
    return d.select("pair", "ts", "pos", F.explode(both).alias("o")).select("pair", "ts", "pos", "o.*")


