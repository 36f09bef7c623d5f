"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.catalog.registry import Tables, fragment, query
from barline.session import shared_folder
from barline.sources import feeds, store

BAR = "pair ts:t bid_open:d bid_high:d bid_low:d bid_close:d ask_open:d ask_high:d ask_low:d ask_close:d"
SIDED = "pair timeframe offer_side ts:t open:d high:d low:d close:d volume:d"


def scratch(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def as_feed(t: Tables) -> str:
    """The hourly bars as feed lines: yen pairs a bar per line, the others nested per day."""
    path = scratch(t, "feed")
    bars = t.hourly().select("pair", F.unix_millis("ts").alias("timestamp"), *feeds.PRICES)
    bars.filter(F.col("pair").endswith("/JPY")).write.json(path + "/flat")
    day = F.to_date(F.timestamp_millis("timestamp")).cast("string")
    nested = bars.filter(~F.col("pair").endswith("/JPY")).groupBy("pair", day.alias("chunk_start")).agg(
        F.collect_list(F.struct("timestamp", *feeds.PRICES)).alias("bars")
    )
    nested.write.json(path + "/nested")
    return path


@query("s1_feed_lines", BAR, "SELECT * FROM x_hbars")
def s1(t: Tables) -> DataFrame:
    path = as_feed(t)
    lines = feeds.good_feeds(t.spark, path + "/flat").unionByName(feeds.good_feeds(t.spark, path + "/nested"))
    return feeds.feed_bars(lines)


@query(
    "s1_feed_report", "pair rows:i reason",
    """SELECT pair, count(*) AS rows, NULL AS reason FROM x_hbars GROUP BY 1 UNION ALL SELECT 'twice ' || pair, count(*) + 1, 'duplicate timestamps' FROM x_hbars GROUP BY pair
UNION ALL SELECT 'empty ' || pair, 0, 'no bars' FROM x_hbars GROUP BY pair""",
)
def s1b(t: Tables) -> DataFrame:
    """The feeds of all pairs, beside feeds whose first bar comes again in a chunk of its own, and feeds of chunks without bars."""
    path = as_feed(t)
    bars = t.hourly().select("pair", F.unix_millis("ts").alias("timestamp"), *feeds.PRICES)
    first = bars.groupBy("pair").agg(F.min_by(F.struct("timestamp", *feeds.PRICES), "timestamp").alias("b"))
    named = lambda d, word: d.withColumn("pair", F.concat_ws(" ", F.lit(word), "pair"))
    named(bars, "twice").write.json(path + "/twice/flat")
    named(first.select("pair", F.array("b").alias("bars")), "twice").write.json(path + "/twice/again")
    named(first.select("pair", F.slice(F.array("b"), 1, 0).alias("bars")), "empty").write.json(path + "/empty")
    return feeds.feed_report(t.spark, f"{path}/{{flat,nested,empty}}").unionByName(feeds.feed_report(t.spark, path + "/twice/*"))


@query(
    "s2_csv_bars", "pair timestamp:i open:d high:d low:d close:d volume:d",
    """SELECT pair, epoch_us(ts) // 1000 AS timestamp, bid_open AS open, bid_high AS high, bid_low AS low, bid_close AS close,
  CASE WHEN volume > 1 THEN volume ELSE 0 END AS volume FROM x_hbars""",
)
def s2(t: Tables) -> DataFrame:
    path = scratch(t, "csv")
    t.hourly().select(
        F.col("pair").alias("Pair"), F.unix_millis("ts").alias("TIMESTAMP"), F.col("bid_open").alias("Open"),
        F.col("bid_high").alias("High"), F.col("bid_low").alias("LOW"), F.col("bid_close").alias("close"),
        F.when(F.col("volume") > 1, F.col("volume")).alias("Volume"),
    ).write.option("header", True).csv(path)
    return feeds.csv_bars(t.spark, path)


@query(
    "s3_epoch_millis", "event_id:i ms:i",
    "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000000 * 1000 END AS ms FROM events",
)
def s3(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.unix_seconds(ts).cast("string"))
        .when(F.col("event_id") % 3 == 1, F.unix_millis(ts).cast("string"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return t.table("events").withColumn("ms", feeds.epoch_millis(text))


def _payload(t: Tables) -> DataFrame:
    d = t.sided().withColumn("day", F.to_date("ts"))
    row = F.struct(
        F.unix_millis("ts").cast("string").alias("timestamp"),
        *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")],
        F.when(F.col("volume") > 1, F.col("volume").cast("string")).alias("volume"),
    )
    return d.groupBy("pair", "timeframe", "offer_side", "day").agg(F.to_json(F.collect_list(row)).alias("payload"))


@query("s4_provider_bars", SIDED, "SELECT * REPLACE (CASE WHEN volume > 1 THEN volume END AS volume) FROM x_sided")
def s4(t: Tables) -> DataFrame:
    return feeds.provider_bars(_payload(t), "payload", ["pair", "timeframe", "offer_side"])


@query(
    "s5_provider_instruments", "id:i name pip_value:d name_long",
    "SELECT p_partkey AS id, p_brand AS name, CASE WHEN p_size > 10 THEN p_retailprice END AS pip_value, CASE WHEN p_size > 25 THEN p_name END AS name_long FROM part",
)
def s5(t: Tables) -> DataFrame:
    row = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("name"),
        F.when(F.col("p_size") > 10, F.col("p_retailprice").cast("string")).alias("pipValue"),
        F.when(F.col("p_size") > 25, F.col("p_name")).otherwise("").alias("nameLong"),
    )
    return feeds.provider_instruments(t.table("part").select(F.to_json(F.array(row)).alias("payload")), "payload")


@query(
    "s6_provider_quotes", "instrument:i ts_ms:i bid:d ask:d",
    "SELECT user_id AS instrument, epoch_us(ts) // 1000 AS ts_ms, value AS bid, value + 0.5 AS ask FROM events",
)
def s6(t: Tables) -> DataFrame:
    row = F.struct(
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"), F.col("user_id").cast("string").alias("instrument"),
        F.col("value").cast("decimal(38,18)").cast("string").alias("bid"),
        (F.col("value") + 0.5).cast("decimal(38,18)").cast("string").alias("ask"),
    )
    q = feeds.provider_quotes(t.table("events").select(F.to_json(F.array(row)).alias("payload")), "payload")
    return q.withColumn("ts_ms", F.unix_millis("ts"))


@query(
    "s7_latest_chunk_wins", "pair ts:t chunk:i close:d",
    """SELECT pair, ts, CASE WHEN extract(hour FROM ts) < 6 AND ts >= TIMESTAMP '2024-01-03' THEN 1 ELSE 0 END AS chunk,
  bid_close + CASE WHEN extract(hour FROM ts) < 6 AND ts >= TIMESTAMP '2024-01-03' THEN 1 ELSE 0 END AS close
FROM x_hbars WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20'""",
)
def s7(t: Tables) -> DataFrame:
    base = t.hourly().select("pair", "ts", F.lit(0).alias("chunk"), F.col("bid_close").alias("close"))
    again = base.filter((F.hour("ts") < 6) & (F.col("ts") >= F.lit("2024-01-03").cast("timestamp"))).select(
        "pair", "ts", F.lit(1).alias("chunk"), (F.col("close") + 1).alias("close")
    )
    start, end = F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    return store.latest_chunk_wins(base.unionByName(again), ["pair"], "chunk", start, end)


@query(
    "s8_scan_windows", "pair window_start:t window_end:t bid_rows:i ask_rows:i",
    """SELECT pair, w AS window_start, least(w + INTERVAL 7 DAY, TIMESTAMP '2024-01-31') AS window_end, count(*) AS bid_rows, count(*) AS ask_rows
FROM x_hbars, (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-30', INTERVAL 7 DAY)) AS w)
WHERE ts >= w AND ts < least(w + INTERVAL 7 DAY, TIMESTAMP '2024-01-31') GROUP BY 1, 2""",
)
def s8(t: Tables) -> DataFrame:
    start, end = F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-31").cast("timestamp")
    requests = t.sided().select("pair").distinct().select("pair", start.alias("start"), end.alias("end"))
    w = store.scan_windows(requests, 7)
    # both sides get the days they touch, so a row meets the windows of its day and not all of its pair
    day = F.floor(F.unix_seconds("ts") / 86400)
    days = F.sequence(F.floor(F.unix_seconds("window_start") / 86400), F.floor((F.unix_seconds("window_end") - 1) / 86400))
    hit = t.sided().withColumn("_day", day).join(w.withColumn("_day", F.explode(days)), ["pair", "_day"]).filter((F.col("ts") >= F.col("window_start")) & (F.col("ts") < F.col("window_end")))
    return hit.groupBy("pair", "window_start", "window_end").agg(
        F.count_if(F.col("offer_side") == "B").alias("bid_rows"), F.count_if(F.col("offer_side") == "A").alias("ask_rows")
    )


@query(
    "s9_idempotent_append", "pair offer_side n:i first_ts:t",
    "SELECT pair, offer_side, count(*) AS n, min(ts) AS first_ts FROM x_sided WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2",
)
def s9(t: Tables) -> DataFrame:
    existing = t.sided().filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    incoming = t.sided().unionByName(t.sided())
    fresh = store.new_rows(existing, incoming, store.BAR_KEY)
    return fresh.groupBy("pair", "offer_side").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query(
    "s10_json_row_upsert", "series_id opened_at:t open:d volume:d trade_count:i source source_hash metadata",
    """SELECT pair || '-' || offer_side AS series_id, ts AS opened_at, open, CASE WHEN volume > 1 THEN volume END AS volume,
  CASE WHEN volume > 2 THEN volume END AS trade_count, CASE WHEN volume > 1 THEN 'feed' ELSE 'unknown' END AS source,
  CASE WHEN volume > 1 THEN 'abc' END AS source_hash, '{}' AS metadata FROM x_sided WHERE ts >= TIMESTAMP '2024-01-10'""",
)
def s10(t: Tables) -> DataFrame:
    v = F.col("volume")
    text = lambda c: c.cast("bigint").cast("string")
    row = F.struct(
        F.concat_ws("-", "pair", "offer_side").alias("series_id"), "timeframe", "offer_side",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("opened_at"),
        *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")],
        F.when(v > 1, text(v)).otherwise("").alias("volume"), F.when(v > 2, text(v)).otherwise("").alias("trade_count"),
        F.when(v > 1, "feed").alias("source"), F.when(v > 1, "abc").otherwise("").alias("source_hash"),
    )
    payload = t.sided().groupBy("pair", "offer_side", F.to_date("ts")).agg(F.to_json(F.collect_list(row)).alias("payload"))
    rows = store.rows_from_json(payload, "payload")
    stored = rows.filter(F.col("opened_at") < F.lit("2024-01-10").cast("timestamp"))
    return store.new_rows(stored, rows, ["series_id", "opened_at"])


@query("s11_append_and_count", "pair n:i", "SELECT pair, count(*) * 2 AS n FROM x_sided GROUP BY 1")
def s11(t: Tables) -> DataFrame:
    path = scratch(t, "cache")
    t.sided().write.mode("append").parquet(path)
    t.sided().write.mode("append").parquet(path)
    return t.spark.read.parquet(path).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query("s12_series_count", "pair timeframe offer_side n:i", "SELECT pair, timeframe, offer_side, count(*) AS n FROM x_sided GROUP BY 1, 2, 3")
def s12(t: Tables) -> DataFrame:
    return t.sided().groupBy("pair", "timeframe", "offer_side").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s13_checkpoints", "user_id:i as_of:t observed_at:t source_hash",
    """SELECT user_id, arg_max(ts - INTERVAL 1 HOUR, event_id) AS as_of, max(ts) AS observed_at, arg_max(event_type, event_id) AS source_hash
FROM events GROUP BY user_id""",
)
def s13(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    seen = t.table("events").select(
        "user_id", (ts - F.expr("interval 1 hour")).alias("as_of"), ts.alias("observed_at"), F.col("event_type").alias("source_hash")
    )
    return store.checkpoints(seen, ["user_id"])


RECORD_JSON = (
    "pair string, ts timestamp, year bigint, session string, regime string, direction string, horizon bigint, k bigint, "
    "agreement double, median_distance double, outcome_pips double, split string, global_split string"
)


@query(
    "s14_record_sink", "pair ts:t horizon:i agreement:d outcome_pips:d split",
    "SELECT * FROM x_rec",
)
def s14(t: Tables) -> DataFrame:
    path = scratch(t, "records")
    store.write_records(t.records(), path)
    return t.spark.read.schema(RECORD_JSON).json(path)


@query("s15_record_document", "pair ts:t horizon:i agreement:d outcome_pips:d split", "SELECT * FROM x_rec")
def s15(t: Tables) -> DataFrame:
    path = scratch(t, "document")
    docs = t.records().groupBy("pair", F.to_date("ts").alias("day")).agg(F.collect_list(F.struct(*RECORD_JSON_NAMES)).alias("target_records"))
    docs.select("target_records").write.json(path)
    return store.read_record_document(t.spark, path, RECORD_JSON)


RECORD_JSON_NAMES = [f.split()[0] for f in RECORD_JSON.split(", ")]


@query("s16_source_manifest", "file bytes:i sha256", None)
def s16(t: Tables) -> DataFrame:
    return store.manifest(t.spark, t.folder, "*.parquet")


fragment("x_lines", """
SELECT pair, offer_side, ts, CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '|' || pair || '|1hour|' || offer_side || '|'
  || CAST(CAST(round(open * 1000000) AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(round(close * 1000000) AS BIGINT) AS VARCHAR) || '|'
  || CAST(CAST(volume AS BIGINT) AS VARCHAR) AS line FROM x_sided""")


@query(
    "s17_content_hash", "pair offer_side rows:i content_hash",
    """SELECT pair, offer_side, sum(n) AS rows, sha256(string_agg(digest, chr(10) ORDER BY day)) AS content_hash
FROM (SELECT pair, offer_side, CAST(ts AS DATE) AS day, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY ts)) AS digest FROM x_lines GROUP BY 1, 2, 3)
GROUP BY 1, 2""",
)
def s17(t: Tables) -> DataFrame:
    micro = lambda c: F.round(F.col(c).cast("double") * 1000000).cast("bigint")
    line = F.concat_ws(
        "|", F.unix_seconds("ts"), "pair", "timeframe", "offer_side", micro("open"), micro("close"), F.col("volume").cast("bigint")
    )
    return store.series_hash(t.sided(), ["pair", "offer_side"], "ts", line)
