"""Deletion of repeated line runs by a suffix array over line identifiers.

A line is what stands between newlines, without white space around it; equal lines have one identifier. Suffixes of the line
sequences are ranked by prefix doubling: the rank by the first 2h lines orders the pairs (rank by h lines at i, rank by h
lines at i + h). Suffixes of one rank are a longest-common-prefix interval of at least h lines. A suffix whose rank no other
has, or that ends before h lines, is in no such interval and leaves, so that the table shrinks with every round. The interval
of suffixes that share any m lines is named by two overlapping ranks, those of 2^k <= m lines at its start and before its
end. For every line the shortest run from it, and the shortest run up to it, that holds ``min_words`` words is looked up in
this way, which decides all of every longer run: in each interval the run that comes first (by document id, then row, then
line) stays, and the lines of all others are deleted. Deleted lines that touch make a maximal run.

Lines without words are lines like others, but no run consists of them alone. Null texts are empty; repeated rows are copies
of each other, of which the first stays; ids may repeat or be null (null sorts first); an empty table gives an empty result.
Texts that lose all lines stay as empty texts. Windows are taken within a document, never within an interval, whose size is
unbounded: intervals are aggregates that are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barline.llm.common import blocks, texts, tidy
from barline.session import written

MIN_WORDS = 5


def _shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest run from, and up to, each line that has at least so many words; 0 where there is none."""
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + least, side="left")
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    return np.where(end <= len(words), end - at, 0), np.where(total[1:] >= least, at + 1 - start, 0)


def line_table(source: DataFrame, min_words: int) -> DataFrame:
    """``row, pos, doc_id, a, b, ahead, back``: 128 bits of each line's hash and the shortest runs from and up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in blocks(batches):
            sizes, hashes, ahead, back = [], [], [], []
            for text in batch.column("text").to_pylist():
                lines = [x.strip() for x in text.split("\n")]
                hashes += [digest(x.encode()) for x in lines]
                n, m = _shortest_runs(np.fromiter((len(x.split()) for x in lines), np.int64, len(lines)), min_words)
                sizes.append(len(lines))
                ahead.append(n)
                back.append(m)
            if not sizes:
                continue
            which = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(which)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
            ab = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [batch.column("row").take(pa.array(which)), pa.array(pos), batch.column("doc_id").take(pa.array(which)), pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()), pa.array(np.concatenate(ahead)), pa.array(np.concatenate(back))],
                names=["row", "pos", "doc_id", "a", "b", "ahead", "back"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"row long, pos long, doc_id {kind}, a long, b long, ahead long, back long")


def _ranked(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows whose pair occurs more than once, with the pair's rank ``r`` in the order of all pairs."""
    pairs = df.groupBy(first, second).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.repartitionByRange(n, first, second).sortWithinPartitions(first, second)
    ranks = written(ordered.withColumn("r", F.monotonically_increasing_id()), "line_ranks")  # grows with partition and place
    return df.join(ranks, [first, second]).drop(first, second)


def repeated_runs(source: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row, start, lines``: the runs of ``row, doc_id, text`` that have come before, shortest ones from and up to each line."""
    lines = written(line_table(source, min_words), "lines")
    ranks = written(_ranked(lines, "a", "b"), "line_suffixes")
    ahead = ranks.where("ahead > 0").select("row", "doc_id", F.col("pos").alias("start"), F.col("ahead").alias("lines"))
    back = ranks.where("back > 0").select("row", "doc_id", (F.col("pos") - F.col("back") + 1).alias("start"), F.col("back").alias("lines"))
    level = F.floor(F.log2(F.col("lines") + F.lit(0.5))).cast("int").alias("level")
    runs = written(ahead.union(back).distinct().select("*", level), "line_runs")
    levels = sorted(r[0] for r in runs.select("level").distinct().collect())  # at most log2 of the longest text's lines
    ranks = ranks.select("row", "pos", "r")
    found, k = [], 0
    for wanted in levels:
        while k < wanted:
            beyond = F.first("r").over(Window.partitionBy("row").orderBy("pos").rangeBetween(1 << k, 1 << k))
            pairs = ranks.select("row", "pos", F.col("r").alias("r1"), beyond.alias("r2")).where(F.col("r2").isNotNull())
            ranks, k = written(_ranked(pairs, "r1", "r2"), "line_suffixes"), k + 1
        at = runs.where(F.col("level") == wanted).select("row", "doc_id", "start", "lines", (F.col("start") + F.col("lines") - (1 << wanted)).alias("other"))
        head = at.join(ranks.select("row", F.col("pos").alias("start"), F.col("r").alias("r1")), ["row", "start"])
        both = head.join(ranks.select("row", F.col("pos").alias("other"), F.col("r").alias("r2")), ["row", "other"])
        place = F.struct("doc_id", "row", "start")
        first = both.groupBy("lines", "r1", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(both.join(first, ["lines", "r1", "r2"]).where(~place.eqNullSafe(F.col("first"))).select("row", "start", "lines"))
    out = source.sparkSession.createDataFrame([], "row long, start long, lines long")
    for f in found:
        out = out.union(f)
    return out


def without(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``row, rest, text, n_lines, deleted`` of ``row, rest, text``: the texts without the runs; ``rest`` is carried along."""
    of_row = runs.groupBy("row").agg(F.collect_set(F.struct("start", "lines")).alias("runs"))  # at most two a line

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            kept, sizes, deleted = [], [], []
            for text, gone_runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                size = text.count("\n") + 1 if text else 1
                sizes.append(size)
                if not gone_runs:
                    kept.append(text)
                    deleted.append([])
                    continue
                gone = np.zeros(size + 2, dtype=np.int64)
                for r in gone_runs:
                    gone[r["start"] + 1] += 1
                    gone[r["start"] + r["lines"] + 1] -= 1
                gone = np.minimum(np.cumsum(gone), 1)
                edge = np.diff(gone)
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                deleted.append([{"start": s, "lines": e - s} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
                kept.append("\n".join([x for x, g in zip(text.split("\n"), gone[1:], strict=False) if not g]))
            yield pa.record_batch(
                [batch.column("row"), batch.column("rest"), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(deleted, pa.list_(pa.struct([("start", pa.int64()), ("lines", pa.int64())])))],
                names=["row", "rest", "text", "n_lines", "deleted"],
            )

    joined = rows.join(of_row.hint("shuffle_hash"), "row", "left").select("row", "rest", "text", "runs")
    fields = [StructField("row", LongType()), StructField("rest", rows.schema["rest"].dataType), *StructType.fromDDL("text string, n_lines long, deleted array<struct<start: long, lines: long>>").fields]
    return joined.mapInArrow(tidy(run), StructType(fields))


def deduplicated(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, text, n_lines, deleted``: the text without repeated runs, and the deleted maximal runs as (start, lines)."""
    source = written(texts(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "line_documents")
    runs = repeated_runs(source.select("row", "doc_id", "text"), min_words)
    return without(source.select("row", F.struct("doc_id").alias("rest"), "text"), runs).select("row", "rest.doc_id", "text", "n_lines", "deleted")


def oracle_sql(min_words: int = MIN_WORDS) -> str:
    """The digest columns of the registered query, by comparing the texts of all runs (ids are taken to be distinct)."""
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
w AS (SELECT *, trim(raw) AS line, len(regexp_extract_all(raw, '\\S+')) AS n FROM l),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM w),
pairs AS (SELECT a.doc_id, a.i AS s, b.i AS e FROM c AS a JOIN c AS b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.total - a.total + a.n >= {min_words}),
runs AS (SELECT doc_id, s, min(e) AS e FROM pairs GROUP BY doc_id, s UNION SELECT doc_id, max(s) AS s, e FROM pairs GROUP BY doc_id, e),
texts AS (SELECT r.doc_id, r.s, r.e, string_agg(w.line, chr(10) ORDER BY w.i) AS content FROM runs AS r JOIN w ON w.doc_id = r.doc_id AND w.i BETWEEN r.s AND r.e GROUP BY r.doc_id, r.s, r.e),
later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY content, e - s ORDER BY doc_id, s) AS k FROM texts) AS t WHERE k > 1),
gone AS (SELECT DISTINCT w.doc_id, w.i FROM later AS t JOIN w ON w.doc_id = t.doc_id AND w.i BETWEEN t.s AND t.e),
islands AS (SELECT doc_id, min(i) AS start, count(*) AS lines FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) AS t GROUP BY doc_id, g),
spans AS (SELECT doc_id, string_agg((start - 1) || '+' || lines, ' ' ORDER BY start) AS deleted, CAST(sum(lines) AS BIGINT) AS n_deleted FROM islands GROUP BY doc_id)
SELECT l.doc_id, count(*) AS n_lines, coalesce(any_value(n_deleted), 0) AS n_deleted, coalesce(any_value(deleted), '') AS deleted,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i LEFT JOIN spans ON spans.doc_id = l.doc_id GROUP BY l.doc_id
"""
