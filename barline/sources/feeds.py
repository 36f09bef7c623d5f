"""Readers for bar feeds (JSON lines, CSV, provider JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.labels import col
from barline.functions.prices import FIELDS, SIDES, crossed, every, finite, geometry_ok

PRICES = [f"{s}_{f}" for s in SIDES for f in FIELDS]
_BAR = [T.StructField("timestamp", T.DoubleType())] + [T.StructField(p, T.DoubleType()) for p in PRICES]
FEED_SCHEMA = T.StructType(
    [
        T.StructField("pair", T.StringType()),
        T.StructField("chunk_start", T.StringType()),
        T.StructField("month_start", T.StringType()),
        T.StructField("bars", T.ArrayType(T.StructType(_BAR))),
        *_BAR,
    ]
)


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, Column]:
    """Raw lines and the bars of each: its chunk, or the line itself."""
    raw = spark.read.schema(FEED_SCHEMA).option("mode", "FAILFAST").json(path)
    flat = F.struct(*[F.col(f.name) for f in _BAR])
    return raw, F.coalesce(F.col("bars"), F.array(flat))


def feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Feed JSON lines, with a bar per line or bars nested in a chunk; malformed lines fail the read."""
    raw, bars = _lines(spark, path)
    return raw.select("pair", F.explode(bars).alias("b")).select("pair", "b.*")


def feed_report(spark: SparkSession, path: str) -> DataFrame:
    """(pair, rows, reason): feeds to reject, those whose chunks hold no bar and those with a time twice; null for good ones."""
    raw, bars = _lines(spark, path)
    d = raw.select("pair", F.explode_outer(bars).alias("b")).select("pair", "b.timestamp", F.col("b").isNotNull().alias("_bar"))
    times = d.groupBy("pair", "timestamp").agg(F.count_if("_bar").alias("_n"))
    feed = times.groupBy("pair").agg(F.sum("_n").alias("rows"), F.max("_n").alias("_most"))
    reason = F.when(F.col("rows") == 0, "no bars").when(F.col("_most") > 1, "duplicate timestamps")
    return feed.select("pair", "rows", reason.alias("reason"))


def good_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a path all of whose feeds are good; any other fails the job with its reason."""
    bad = F.concat_ws(": ", F.lit("rejected feed"), "pair", "reason")
    fine = feed_report(spark, path).filter(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(bad).cast("boolean")))
    return feed_lines(spark, path).join(fine.select("pair"), "pair", "left_semi")


def feed_bar_ok() -> Column:
    """Prices are finite and positive, both sides enclose open and close, time is a positive whole millisecond."""
    t = F.col("timestamp")
    numbers = every([finite(F.col(p)) & (F.col(p) > 0) for p in PRICES])
    return numbers & geometry_ok("bid_") & geometry_ok("ask_") & finite(t) & (t > 0) & (t == F.floor(t))


def feed_bars(lines: DataFrame) -> DataFrame:
    """Valid feed bars with a UTC time; a bad bar fails the job."""
    ok = F.when(feed_bar_ok(), True).otherwise(F.raise_error(F.lit("invalid feed bar")).cast("boolean"))
    return lines.filter(ok).select("pair", F.timestamp_millis(F.col("timestamp").cast("bigint")).alias("ts"), *PRICES)


def crossed_report(bars: DataFrame, limit: float = 0.001) -> DataFrame:
    """Rows, crossed rows and their share per pair; a pair above the limit is rejected."""
    r = bars.groupBy("pair").agg(F.count(F.lit(1)).alias("rows"), F.count_if(crossed()).alias("crossed"))
    share = F.col("crossed") / F.col("rows")
    return r.withColumn("crossed_share", share).withColumn("accepted", share <= limit)


def without_crossed(bars: DataFrame, limit: float = 0.001) -> DataFrame:
    """Drop crossed bars, never clip prices; a pair with too many of them fails the job."""
    report = crossed_report(bars, limit)
    guard = F.when(F.col("accepted"), True).otherwise(F.raise_error(F.lit("too many crossed bars")).cast("boolean"))
    return bars.filter(~crossed()).join(report.filter(guard).select("pair"), "pair", "left_semi")


def epoch_millis(value: str | Column) -> Column:
    """Seconds, milliseconds (1e11 and more) or ISO text with a zone, as epoch milliseconds."""
    text = F.trim(col(value))
    number = text.try_cast("double")
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    iso = F.when(zoned, F.unix_millis(F.try_to_timestamp(text)))
    return F.when(number.isNotNull(), F.when(F.abs(number) >= 1e11, number).otherwise(number * 1000).cast("bigint")).otherwise(iso)


def csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """CSV bars with headers in any case; a missing volume counts as 0."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    missing = {"timestamp", "open", "high", "low", "close"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    volume = F.coalesce(F.col("volume").try_cast("double"), F.lit(0.0)) if "volume" in raw.columns else F.lit(0.0)
    ms = epoch_millis("timestamp")
    known = [c for c in raw.columns if c not in {"timestamp", *FIELDS, "volume"}]
    return raw.select(
        *known,
        F.coalesce(ms, F.raise_error(F.lit("timestamp must be epoch or ISO with a zone")).cast("bigint")).alias("timestamp"),
        *[F.col(f).cast("double").alias(f) for f in FIELDS],
        volume.alias("volume"),
    )


_JSON_BARS = "array<struct<timestamp:string,open:string,high:string,low:string,close:string,volume:string>>"
_JSON_INSTRUMENTS = "array<struct<id:string,name:string,pipValue:string,nameLong:string>>"
_JSON_QUOTES = "array<struct<timestamp:string,instrument:string,bid:string,ask:string>>"


def _required(value: Column, kind: str, name: str) -> Column:
    c = value.try_cast(kind)
    return F.coalesce(c, F.raise_error(F.lit(f"invalid or missing {name}")).cast(kind))


def _items(df: DataFrame, payload: str, schema: str, keep: list[str]) -> DataFrame:
    parsed = F.from_json(payload, schema, {"mode": "FAILFAST"})
    return df.select(*keep, F.explode(parsed).alias("r"))


def provider_bars(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Provider JSON arrays of bars to decimal bars; a malformed field fails the job."""
    d = _items(df, payload, _JSON_BARS, keep)
    return d.select(
        *keep,
        F.timestamp_millis(_required(F.col("r.timestamp"), "bigint", "timestamp")).alias("ts"),
        *[_required(F.col(f"r.{f}"), "decimal(38,18)", f).alias(f) for f in FIELDS],
        F.col("r.volume").cast("decimal(38,18)").alias("volume"),
    )


def provider_instruments(df: DataFrame, payload: str) -> DataFrame:
    d = _items(df, payload, _JSON_INSTRUMENTS, [])
    return d.select(
        _required(F.col("r.id"), "int", "id").alias("id"),
        _required(F.col("r.name"), "string", "name").alias("name"),
        F.col("r.pipValue").cast("decimal(38,18)").alias("pip_value"),
        F.nullif(F.col("r.nameLong"), F.lit("")).alias("name_long"),
    )


def provider_quotes(df: DataFrame, payload: str) -> DataFrame:
    """Provider JSON quotes; works on a stream as well."""
    d = _items(df, payload, _JSON_QUOTES, [])
    return d.select(
        F.timestamp_millis(_required(F.col("r.timestamp"), "bigint", "timestamp")).alias("ts"),
        _required(F.col("r.instrument"), "int", "instrument").alias("instrument"),
        _required(F.col("r.bid"), "decimal(38,18)", "bid").alias("bid"),
        _required(F.col("r.ask"), "decimal(38,18)", "ask").alias("ask"),
    )
