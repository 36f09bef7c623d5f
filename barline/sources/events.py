"""Paired and one-sided bars from a table of price events (ticks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event types quoted in yen; all others are quoted in dollars.
YEN_TYPES = ("purchase", "signup")

# One unit of an event's value is one pip above these prices.
YEN_BASE, BASE = 100.0, 1.0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(events: DataFrame) -> DataFrame:
    """One positive price per event: pair, time in UTC, and the spread key of its props."""
    yen = F.col("event_type").isin(*YEN_TYPES)
    quote = F.when(yen, F.lit("/JPY")).otherwise(F.lit("/USD"))
    price = F.when(yen, YEN_BASE + F.col("value") / 100.0).otherwise(BASE + F.col("value") / 10000.0)
    return events.filter(F.col("value") > 0).select(
        F.concat(F.upper("event_type"), quote).alias("pair"),
        F.col("ts").cast("timestamp").alias("tick_ts"),
        "event_id",
        price.alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def bucket(ts: str | Column, seconds: int) -> Column:
    """Start of the fixed-width bucket that holds ``ts``."""
    s = F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts)
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds)))


def paired_bars(events: DataFrame, interval_s: int) -> DataFrame:
    """BID/ASK bars: the ask is the bid plus the spread of the last tick in the bucket.

    Ticks are ordered by (time, id); a bar is one aggregate with map-side partials.
    """
    t = ticks(events).withColumn("ts", bucket("tick_ts", interval_s))
    order = F.struct("tick_ts", "event_id")
    bid = t.groupBy("pair", "ts").agg(
        F.min_by("price", order).alias("bid_open"),
        F.max("price").alias("bid_high"),
        F.min("price").alias("bid_low"),
        F.max_by("price", order).alias("bid_close"),
        F.max_by("k", order).alias("_k"),
        F.count(F.lit(1)).alias("volume"),
    )
    tenths = (1 + F.col("_k") % 10).cast("double")
    spread = F.when(F.col("pair").endswith("/JPY"), tenths / 1000.0).otherwise(tenths / 100000.0)
    for side in ("open", "high", "low", "close"):
        bid = bid.withColumn(f"ask_{side}", F.col(f"bid_{side}") + spread)
    return bid.select(
        "pair", "ts", "bid_open", "bid_high", "bid_low", "bid_close",
        "ask_open", "ask_high", "ask_low", "ask_close",
        *[F.lit(None).cast("double").alias(f"spread_{s}") for s in ("open", "high", "low", "close")],
        "volume",
    )


def sided_bars(bars: DataFrame, timeframe: str = "1hour") -> DataFrame:
    """Split paired bars into one BID and one ASK row each, with decimal prices."""
    side = lambda code, p: F.struct(
        F.lit(code).alias("offer_side"),
        *[F.col(f"{p}_{c}").cast("decimal(38,18)").alias(c) for c in ("open", "high", "low", "close")],
    )
    volume = F.col("volume") if "volume" in bars.columns else F.lit(None)
    return bars.select(
        "pair",
        "ts",
        F.lit(timeframe).alias("timeframe"),
        F.explode(F.array(side("B", "bid"), side("A", "ask"))).alias("s"),
        volume.cast("decimal(38,18)").alias("volume"),
    ).select("pair", "timeframe", "s.offer_side", "ts", "s.open", "s.high", "s.low", "s.close", "volume")
