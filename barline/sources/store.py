"""Bar tables, checkpoints, artifacts and content hashes."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.labels import col
from barline.session import written

BAR_KEY = ("pair", "timeframe", "offer_side", "ts")


def latest_chunk_wins(rows: DataFrame, keys: Sequence[str], chunk: str, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """Overlapping chunks: keep each time's row of the last chunk, clipped to [start, end)."""
    w = Window.partitionBy(*keys, ts).orderBy(F.col(chunk).desc())
    inside = rows.filter((F.col(ts) >= start) & (F.col(ts) < end))
    return inside.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def scan_windows(requests: DataFrame, days: int, start: str = "start", end: str = "end") -> DataFrame:
    """Split [start, end) of each request into half-open windows of ``days`` days."""
    step = F.expr(f"interval {int(days)} days")
    starts = F.sequence(F.col(start), F.col(end) - F.expr("interval 1 microsecond"), step)
    d = requests.filter(F.col(start) < F.col(end)).withColumn("window_start", F.explode(starts))
    return d.withColumn("window_end", F.least(F.col("window_start") + step, F.col(end)))


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], first: Sequence[str | Column] = ()) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key: the first by ``first``, then by all columns."""
    order = [*first, *[c for c in incoming.columns if c not in keys]]
    w = Window.partitionBy(*keys).orderBy(*order) if order else None
    one = incoming.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn") if order else incoming.distinct()
    return one.join(existing.select(*keys), list(keys), "left_anti")


def append_bars(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str] = BAR_KEY, ts: str = "ts", first: Sequence[str | Column] = ()) -> int:
    """Idempotent append to a Parquet table; returns the number of rows stored.

    Of the stored side only the incoming rows' time range is read, by the files' statistics.
    """
    try:
        existing = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = incoming.limit(0)
    low, high = incoming.agg(F.min(ts), F.max(ts)).first()
    if low is None:
        return 0
    fresh = written(new_rows(existing.filter(F.col(ts).between(low, high)), incoming, keys, first), "append")
    fresh.write.mode("append").parquet(path)
    return fresh.count()


JSON_ROWS = (
    "array<struct<series_id:string,timeframe:string,offer_side:string,opened_at:string,open:string,high:string,low:string,"
    "close:string,volume:string,trade_count:string,source:string,source_hash:string,metadata:string>>"
)


def rows_from_json(df: DataFrame, payload: str) -> DataFrame:
    """JSON row arrays with casts, empty text as null, and defaults."""
    d = df.select(F.inline(F.from_json(payload, JSON_ROWS)))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return d.select(
        "series_id", "timeframe", "offer_side",
        F.col("opened_at").cast("timestamp").alias("opened_at"),
        *[F.col(c).cast("decimal(38,18)").alias(c) for c in ("open", "high", "low", "close")],
        empty("volume").cast("decimal(38,18)").alias("volume"),
        empty("trade_count").cast("bigint").alias("trade_count"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        empty("source_hash").alias("source_hash"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
    )


def checkpoints(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last write per series: the mark with the latest observation time."""
    return observations.groupBy(*keys).agg(
        F.max_by(F.struct("as_of", "source_hash"), "observed_at").alias("m"), F.max("observed_at").alias("observed_at")
    ).select(*keys, "m.as_of", "observed_at", "m.source_hash")


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_record_document(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON documents with a ``target_records`` array, one row per record."""
    raw = spark.read.schema(f"target_records array<struct<{schema}>>").option("multiLine", multi_line).json(path)
    return raw.select(F.inline("target_records"))


WHOLE_BYTES = 64 << 20  # of a file that one row may hold


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 and size of every input file.

    Files of at most ``WHOLE_BYTES`` are hashed in tasks, one row each. A longer one passes through the driver's JVM as a stream
    with a small buffer, as Python tasks have no access to Hadoop's file systems: a file of any length takes no more memory.
    """
    longest = min(WHOLE_BYTES, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    hashed = files.where(F.col("length") <= longest).select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > longest).select("path", name, "length").collect()  # one row a file, without content
    if not large:
        return hashed
    with ThreadPoolExecutor(8) as pool:
        digests = pool.map(lambda r: _streamed_sha256(spark, r.path), large)
        rows = [(r.file, r.length, d) for r, d in zip(large, digests, strict=True)]
    return hashed.union(spark.createDataFrame(rows, hashed.schema))


def _streamed_sha256(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON of the columns in name order, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def fingerprint(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def series_hash(rows: DataFrame, keys: Sequence[str], ts: str, line: Column, block: Column | None = None) -> DataFrame:
    """SHA-256 of each series' lines in time order, by way of one digest per day.

    The lines of a day are joined and hashed, then the day digests are: no task holds a whole series.
    """
    day = F.to_date(col(ts)) if block is None else block
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), line.alias("l")))), lambda x: x["l"]), "\n")
    digests = rows.groupBy(*keys, day.alias("_day")).agg(F.sha2(text, 256).alias("_digest"), F.count(F.lit(1)).alias("_n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_day", "_digest"))), lambda x: x["_digest"]), "\n")
    return digests.groupBy(*keys).agg(F.sha2(whole, 256).alias("content_hash"), F.sum("_n").alias("rows"))


def refresh_derived(spark: SparkSession, path: str, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the rows of the given keys in a small derived table; other rows stay.

    Parquet has no MERGE, so each state is a new version beside the last one, and the newest is the table.
    """
    version = 0
    try:
        versions = spark.read.parquet(path)
        version = versions.agg(F.max("version")).first()[0]
        old = versions.filter(F.col("version") == version).drop("version")
        table = table.unionByName(old.join(table.select(*keys).distinct(), list(keys), "left_anti"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    table.write.parquet(f"{path}/version={version + 1}")
    return spark.read.parquet(path).filter(F.col("version") == version + 1).drop("version")
