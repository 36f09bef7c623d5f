"""Importance resampling of documents towards a target, by Arrow kernels over hashed n-grams.

A block of documents is lower-cased with ``ascii_lower``, cut with ``split_pattern_regex``, flattened with ``list_flatten`` and
encoded with ``dictionary_encode``. Shifted dictionary indices side by side are pairs, pairs beside a further index are
triples; each distinct word, pair and triple of the block gets its CRC once, a longer one from that of its beginning. The first
pass adds up features by bucket in each task, so a task sends one row a bucket at most; the gains of the buckets, 80 kB
whatever the input, are broadcast, and the second pass takes the gain of every feature and sums them by document. The highest
scores are ranked after a range partition on (score, doc_id): ranks are the row's place in its partition plus the rows before it.

A null or empty text, or one without words, has no features and weight 0; a null doc_id draws its noise from the empty string and
comes last among ties; repeated rows each count and may each be drawn; an empty table gives an empty result. A text of any
length is taken whole. With an empty target or source its buckets count 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import blocks, texts
from barline.session import written

BUCKETS = 10_000
RUN = 3  # words in the longest feature
LEAST_WORDS = 20
PERCENT = 5
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Features:
    """The features of a block of documents: for each run length the documents of all runs, their dictionary index, and the buckets of the dictionary."""

    def __init__(self, text: pa.Array, buckets: int = BUCKETS):
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(text, "")), pattern=BREAK)
        words, of = pc.list_flatten(lists), pc.list_parent_indices(lists)
        real = pc.greater(pc.binary_length(words), 0)
        words, of = words.filter(real), of.filter(real)
        self.rows = len(text)
        self.n_words = np.bincount(of.to_numpy(zero_copy_only=False), minlength=self.rows)
        coded = pc.dictionary_encode(words)
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        word, doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), of.to_numpy(zero_copy_only=False)
        spelled = [w.encode() for w in coded.dictionary.to_pylist()]
        tails = [b" " + w for w in spelled]
        crc = np.array([zlib.crc32(w) for w in spelled], dtype=np.int64)
        self.runs = [(doc, word, crc % buckets)]
        run = word
        for length in range(2, RUN + 1):
            together = doc[length - 1 :] == doc[: len(doc) - length + 1] if len(doc) >= length else np.zeros(0, dtype=bool)
            pairs = run[: len(together)] * max(1, len(spelled)) + word[length - 1 :][: len(together)]
            coded = pc.dictionary_encode(pa.array(pairs))
            begin, end = np.divmod(coded.dictionary.to_numpy(zero_copy_only=False), max(1, len(spelled)))
            crc = np.array([zlib.crc32(tails[w], c) for c, w in zip(crc[begin].tolist(), end.tolist(), strict=True)], dtype=np.int64)
            run = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            # a run of which another document holds a part is in the dictionary, but counts for nobody
            self.runs.append((doc[: len(together)][together], run[together], crc % buckets))

    def counts(self, buckets: int = BUCKETS) -> np.ndarray:
        """Features by bucket."""
        total = np.zeros(buckets, dtype=np.int64)
        for _, index, bucket in self.runs:
            if len(bucket):
                np.add.at(total, bucket, np.bincount(index, minlength=len(bucket)))
        return total

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and the sum of their gains, by document."""
        n, weight = np.zeros(self.rows, dtype=np.int64), np.zeros(self.rows, dtype=np.int64)
        for doc, index, bucket in self.runs:
            if not len(doc):
                continue
            gained = pc.take(pa.array(gains[bucket]), pa.array(index)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            weight[doc[starts]] += np.add.reduceat(gained, starts)
            n[doc[starts]] += np.diff(np.r_[starts, len(doc)])
        return n, weight


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in blocks(batches):
            total += Features(batch.column("text"), buckets).counts(buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    found = texts(df, df.columns[0], text_col).select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, dtype=np.int64)
    for bucket, n in found:  # one row a bucket
        total[bucket] = n
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, target over source, rounded down."""
    n = len(source)
    s, t = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(df: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` for each row."""
    source = texts(df, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    known = df.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = known.value
        for batch in blocks(batches):
            found = Features(batch.column("text"), len(gain))
            n, weight = found.sums(gain)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.n_words, pa.int64()), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resampled(df: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: scores with Gumbel noise by doc_id; the rank of the drawn rows, null for others."""
    gains = bucket_gains(bucket_counts(df, text_col), bucket_counts(target, text_col))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighed(df, gains, id_col, text_col).select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("open")
    )
    scored = written(scored, "resampling_scores")
    order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    # the id that Spark gives rows in place: the partition above bit 33, the place in it below
    placed = written(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "resampling_places")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("open").cast("long")).alias("open")).orderBy("part").collect()  # one row a partition
    before, starts = 0, []
    for p, n, _ in sizes:
        starts.append((p, before))
        before += n
    drawn = percent * sum(r.open for r in sizes) // 100
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    d = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return d.select("doc_id", "n_features", "weight", "score", F.when(F.col("open") & (rank <= drawn), rank).alias("rank"))


def oracle_sql() -> str:
    """CRCs of words byte by byte; those of longer runs by shifting the CRC of the beginning over the bytes of the last word."""

    def shifted(crc: str, length: str, name: str) -> tuple[str, str]:
        joins = " ".join(f"JOIN z {name}{j} ON {name}{j}.k = {length} * 1024 + {256 * j} + (({crc} >> {8 * j}) & 255)" for j in range(4))
        return joins, f"xor(xor({name}0.v, {name}1.v), xor({name}2.v, {name}3.v))"

    two, second = shifted("p.head", "p.size", "a")
    three, third = shifted("q.head", "q.size", "b")
    blank, after = shifted("w.crc", "1", "c")
    blank2, after2 = shifted("r.crc", "1", "e")
    space = zlib.crc32(b" ")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, 0 AS kind, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT row_number() OVER (), item_id, 1, coalesce(text, '') FROM benchmark),
cut AS MATERIALIZED (SELECT r, doc_id, kind, regexp_extract_all(translate(t, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM docs),
tok AS (SELECT r, kind, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM cut),
steps(b, c, i) AS (SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8),
t256 AS MATERIALIZED (SELECT b, c AS v FROM steps WHERE i = 8),
words AS MATERIALIZED (SELECT DISTINCT w, hex(encode(w)) AS x, strlen(w) AS n FROM tok),
byte(w, x, n, p, c) AS (SELECT w, x, n, 0, 4294967295::BIGINT FROM words UNION ALL
  SELECT byte.w, x, n, p + 1, xor(c >> 8, v) FROM byte JOIN t256 ON b = xor(c & 255,
    16 * (strpos('0123456789ABCDEF', substr(x, 2 * p::INT + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(x, 2 * p::INT + 2, 1)) - 1) WHERE p < n),
w0 AS (SELECT w, n, xor(c, 4294967295::BIGINT) AS crc FROM byte WHERE p = n),
z0(k, v) AS (SELECT j.range * 256 + b.range, b.range << (8 * j.range) FROM range(4) j, range(256) b UNION ALL
  SELECT k + 1024, xor(z0.v >> 8, t.v) FROM z0 JOIN t256 t ON t.b = z0.v & 255 WHERE k < 1024 * (SELECT max(n) FROM words)),
z AS MATERIALIZED (SELECT k, v FROM z0),
w1 AS MATERIALIZED (SELECT w.w, w.n, w.crc, xor({after}, {space}) AS spaced FROM w0 w {blank}),
seq AS MATERIALIZED (SELECT r, kind, p, w1.w, crc, n, spaced, lead(w1.w) OVER o AS w2, lead(w1.w, 2) OVER o AS w3, lead(crc) OVER o AS crc2, lead(n) OVER o AS n2,
  lead(crc, 2) OVER o AS crc3, lead(n, 2) OVER o AS n3 FROM tok JOIN w1 USING (w) WINDOW o AS (PARTITION BY kind, r ORDER BY p)),
pairs AS MATERIALIZED (SELECT DISTINCT w, w2, spaced AS head, crc2 AS tail, n2 AS size FROM seq WHERE w2 IS NOT NULL),
r2 AS MATERIALIZED (SELECT w, w2, xor({second}, p.tail) AS crc FROM pairs p {two}),
r3 AS MATERIALIZED (SELECT r.w, r.w2, r.crc, xor({after2}, {space}) AS spaced FROM r2 r {blank2}),
triples AS MATERIALIZED (SELECT DISTINCT s.w, s.w2, s.w3, r3.spaced AS head, s.crc3 AS tail, s.n3 AS size FROM seq s JOIN r3 USING (w, w2) WHERE w3 IS NOT NULL),
r4 AS (SELECT w, w2, w3, xor({third}, q.tail) AS crc FROM triples q {three}),
f AS MATERIALIZED (SELECT kind, r, crc % 10000 AS bucket FROM seq
  UNION ALL SELECT kind, r, r2.crc % 10000 FROM seq JOIN r2 USING (w, w2) UNION ALL SELECT kind, r, r4.crc % 10000 FROM seq JOIN r4 USING (w, w2, w3)),
g AS (SELECT range AS bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM range(10000) LEFT JOIN f ON bucket = range GROUP BY ALL),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM g),
sums AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN gains USING (bucket) WHERE kind = 0 GROUP BY r),
scored AS (SELECT doc_id, len(ws) >= 20 AS open, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM cut LEFT JOIN sums USING (r) WHERE kind = 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY open DESC, score DESC, doc_id) AS place, sum(open::INT) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND place <= 5 * n // 100 THEN place END AS rank FROM ranked"""
