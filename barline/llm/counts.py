"""Token counts of documents from the counts of their distinct pre-tokens.

Each distinct pre-token of the corpus is encoded once. A bounded dictionary of the most frequent ones is broadcast, so that
most of a document's count is summed where the document is read; the pre-tokens outside it leave as (document, pre-token,
frequency) rows and are joined to the encoded dictionary. No ids are kept anywhere.

Nulls and empty texts have no tokens; repeated rows stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import blocks, most_frequent, texts
from barline.llm.pieces import pretokens, vocabulary
from barline.session import written

HEAD = 300_000  # pre-tokens of at most 64 bytes in the broadcast dictionary: under 25 MB at any input size


def pretoken_counts(source: DataFrame) -> DataFrame:
    """``pretoken, n``: occurrences of each distinct pre-token. Counted in each task first, so a frequent one is a row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=32 << 20):
            seen: Counter[str] = Counter()
            for t in batch.column("text").to_pylist():
                seen.update(pretokens(t))
            yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pretoken", "n"])

    return source.select("text").mapInArrow(run, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(counted: DataFrame, path: str) -> DataFrame:
    """``pretoken, n, pieces``: each distinct pre-token is encoded by the library once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, newline = vocabulary(path).library, "\n"
        for batch in batches:
            tokens = batch.column("pretoken").to_pylist()
            pieces = []
            for start in range(0, len(tokens), 16):
                part = tokens[start : start + 16]
                # A newline before each keeps them apart; it is one id, and cuts a joined text's ids into those of its parts.
                ids = library.encode(newline + newline.join(part), num_threads=1)[1:]
                pieces += _sizes(ids, part, library)
            yield pa.record_batch([batch.column("pretoken"), batch.column("n"), pa.array(pieces, pa.int64())], names=["pretoken", "n", "pieces"])

    return counted.mapInArrow(run, "pretoken string, n long, pieces long")


def _sizes(ids: list[int], part: list[str], library) -> list[int]:  # noqa: ANN001
    newline = ids[0]
    starts = [i for i, x in enumerate(ids) if x == newline]
    if len(starts) != len(part):  # a pre-token holds a newline itself
        return [len(library.encode("\n" + p)) - 2 for p in part]
    return [b - a - 1 for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]


def token_counts(df: DataFrame, path: str, limit: int = 4096, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``df``."""
    spark = df.sparkSession
    source = texts(df, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    dictionary = written(piece_counts(pretoken_counts(source), path), "pieces")
    frequent = dict(most_frequent(dictionary, "pretoken", "n", head).select("pretoken", "pieces").toPandas().itertuples(index=False, name=None))
    known = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document with the sum over frequent pre-tokens, then a row for each other pre-token; ``row`` tells repeated ids apart."""
        pieces = known.value
        for batch in blocks(batches):
            ids, rows, sizes, sums, tokens, times = [], [], [], [], [], []
            for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                cut = pretokens(text)
                counted = list(map(pieces.get, cut))
                rare: Counter[str] = Counter()
                if None in counted:
                    rare.update([p for p, c in zip(cut, counted, strict=True) if c is None])
                    counted = [c for c in counted if c is not None]
                n = len(rare) + 1
                ids += [doc] * n
                rows += [row] * n
                sizes += [len(text.encode()), *[None] * (n - 1)]
                sums += [sum(counted), *[None] * (n - 1)]
                tokens += [None, *rare]
                times += [None, *rare.values()]
            yield pa.record_batch(
                [pa.array(ids, batch.schema.field("doc_id").type), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(tokens, pa.string()), pa.array(times, pa.int64())],
                names=["doc_id", "row", "n_bytes", "sum", "pretoken", "times"],
            )

    numbered = source.withColumn("row", F.monotonically_increasing_id())
    parts = written(numbered.mapInArrow(run, f"doc_id {kind}, row long, n_bytes long, sum long, pretoken string, times long"), "pretoken_parts")
    rare = (
        parts.where(F.col("pretoken").isNotNull())
        .join(dictionary.select("pretoken", "pieces"), "pretoken")
        .groupBy("doc_id", "row")
        .agg(F.sum(F.col("times") * F.col("pieces")).alias("rare"))
    )
    whole = parts.where(F.col("pretoken").isNull()).select("doc_id", "row", "n_bytes", "sum")
    n = (F.col("sum") + F.coalesce("rare", F.lit(0))).alias("n_tokens")
    # doc_id may be null, row never is
    joined = whole.join(rare.drop("doc_id"), "row", "left")
    return joined.select("doc_id", "n_bytes", n).withColumn("over_limit", F.col("n_tokens") > limit)
