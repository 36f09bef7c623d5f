"""Bar resampling and BID/ASK joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.sources.events import bucket

SIDE_KEY = ("pair", "timeframe", "offer_side")


def _rolled(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    return d.groupBy(*keys, "bucket_ts").agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("_n"),
        F.min("ts").alias("_first"),
        F.max("ts").alias("_last"),
    )


def resample(bars: DataFrame, step_s: int, size: int, keys: Sequence[str] = SIDE_KEY) -> DataFrame:
    """Complete, aligned, gap-free groups of ``size`` bars; times inside a group are distinct.

    Accepted when the first row sits on the boundary and the size-th row closes the group; a whole
    group in one hash aggregate, no window.
    """
    d = bars.withColumn("bucket_ts", bucket("ts", step_s * size))
    out = _rolled(d, keys)
    span = F.unix_seconds("_last") - F.unix_seconds("_first")
    whole = (F.col("_n") == size) & (F.col("_first") == F.col("bucket_ts")) & (span == (size - 1) * step_s)
    return out.filter(whole).select(*keys, F.col("bucket_ts").alias("ts"), "open", "high", "low", "close", "volume")


def resample_pairs(bars: DataFrame, step_s: int, keys: Sequence[str] = SIDE_KEY) -> DataFrame:
    """Buckets of two steps holding exactly two bars one step apart, wherever in the bucket they start."""
    d = bars.withColumn("bucket_ts", bucket("ts", step_s * 2))
    out = _rolled(d, keys)
    apart = F.unix_seconds("_last") - F.unix_seconds("_first") == step_s
    return out.filter((F.col("_n") == 2) & apart).select(
        *keys, F.col("bucket_ts").alias("ts"), "open", "high", "low", "close", "volume"
    )


def resample_on_grid(bars: DataFrame, step_s: int, keys: Sequence[str] = SIDE_KEY) -> DataFrame:
    """Two-step buckets from bars on the two grid points; other and non-finite bars are skipped first."""
    offset = F.pmod(F.unix_seconds("ts"), F.lit(2 * step_s))
    good = offset.isin(0, step_s)
    for c in ("open", "high", "low", "close"):
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return resample(bars.filter(good), step_s, 2, keys)


def merge_sides(bars: DataFrame) -> DataFrame:
    """BID and ASK rows of a time joined to one paired bar; times on one side only are left out."""
    return _joined(bars, "inner")


def _joined(bars: DataFrame, how: str) -> DataFrame:
    def side(code: str, prefix: str) -> DataFrame:
        return bars.filter(F.col("offer_side") == code).select(
            "pair", "ts", *[F.col(c).cast("double").alias(f"{prefix}_{c}") for c in ("open", "high", "low", "close")]
        )

    return side("B", "bid").join(side("A", "ask"), ["pair", "ts"], how)


def merge_sides_strict(bars: DataFrame, fill: Sequence[str] = ("open", "close")) -> DataFrame:
    """As ``merge_sides``, but a time on one side only fails the job; spread columns as asked for."""
    d = _joined(bars, "full_outer")
    both = F.col("bid_open").isNotNull() & F.col("ask_open").isNotNull()
    ok = F.when(both, True).otherwise(F.raise_error(F.lit("BID and ASK times differ")).cast("boolean"))
    spreads = [
        (F.col(f"ask_{c}") - F.col(f"bid_{c}") if c in fill else F.lit(None).cast("double")).alias(f"spread_{c}")
        for c in ("open", "high", "low", "close")
    ]
    return d.filter(ok).select("*", *spreads)


def side_alignment(bars: DataFrame) -> DataFrame:
    """Per pair: times without an ask, times without a bid, and whether the sides match exactly."""
    d = bars.groupBy("pair", "ts").agg(
        F.max((F.col("offer_side") == "B").cast("int")).alias("_b"), F.max((F.col("offer_side") == "A").cast("int")).alias("_a")
    )
    r = d.groupBy("pair").agg(
        F.count_if(F.col("_a") == 0).alias("missing_ask"), F.count_if(F.col("_b") == 0).alias("missing_bid"),
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("both"),
    )
    return r.withColumn("aligned", (F.col("missing_ask") == 0) & (F.col("missing_bid") == 0))


