"""Stages of a training-data pipeline over the documents table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and reread as the next one's docs.
What a stage wrote for its own use is deleted when the next one begins, so the disk holds the tables of one stage at a time.
Stages set the session's Arrow batches to at most ``ARROW`` rows and bytes: by default a task's whole partition goes to its
Python worker as one batch, held by both at once.
All but the last return the columns of documents. Rows keep their identity by their number, so repeated or null ids are no
matter; nulls in text are empty texts to every decision and stay null in rows that are kept unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import lines, pieces, shingles, tiling, toxicity
from barline.llm.catalog import PIECES
from barline.session import discard, products, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
_OWN: dict[str, list[str]] = {}  # tables of the last stage, by application


def _setting(spark: SparkSession, key: str) -> int:
    """A whole number, of bytes too; 0 where it is written otherwise."""
    held = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    return int(held[1]) if held else 0


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        discard(spark, _OWN.pop(app, []))
        spark._jvm.System.gc()  # Spark drops broadcasts and shuffles of the last stage when the driver's plans of it are collected
        for key, most in ARROW.items():
            if not 0 < _setting(spark, key) <= most:
                spark.conf.set(key, str(most))
        before = set(products(spark))
        out = work(spark, docs, sf_dir)
        _OWN[app] = [p for p in products(spark) if p not in before]
        return out

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text, rest``: the documents under a number; ``rest`` holds all columns but the text, whatever their names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.struct(*rest).alias("rest"))


def _documents(df: DataFrame, docs: DataFrame, n_chars: Column | None = None) -> DataFrame:
    """Back to the columns of documents."""
    held = {"text": F.col("text")} | ({"n_chars": n_chars} if n_chars is not None and "n_chars" in docs.columns else {})
    return df.select(*[held.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))


@_stage
def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity machine predicts toxic; it is fitted on the labels of this stage's documents."""
    model = toxicity.fitted(docs, _table(spark, sf_dir, "labels"))
    return _documents(toxicity.flagged(_rows(docs), model).where("score < 0.5"), docs)


@_stage
def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes the later copies of repeated line runs; ``n_chars`` follows the text. A document that loses all lines stays, empty."""
    rows = written(_rows(docs), "stage_documents")
    kept = lines.without(rows.select("row", "rest", "text"), lines.repeated_runs(_texts(rows)))
    sizes = None
    if "n_chars" in docs.columns:
        sizes = F.when(F.size("deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return _documents(kept, docs, sizes)


@_stage
def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of texts alike in 0.8 of their five-word shingles: that with the smallest id, then row.

    Candidates are SimHash fingerprints joined on Golay keys, and classes with a common key of minimum hashes for what lies beyond
    two bits; a link is what the whole sets confirm.
    """
    rows = written(_rows(docs), "stage_documents")
    named = shingles.near_duplicates(rows.select("row", "text")).select(F.col("doc_id").alias("row"), "component_id")
    first = rows.select("row", "doc_id").join(named, "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row"))
    return _documents(rows.join(first.select("row"), "row", "left_semi"), docs)


@_stage
def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover half of a benchmark item or more."""
    rows = written(_rows(docs), "stage_documents")
    items = written(tiling.numbered(_table(spark, sf_dir, "benchmark"), "item_id"), "items")
    leaks = tiling.matches(_texts(rows), items).select("row").distinct()
    return _documents(rows.join(leaks, "row", "left_anti"), docs)


@_stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document, and digests of them and of the text they decode to."""
    return pieces.digests(docs, PIECES)


STAGES = [("toxicity", toxic_out), ("line dedup", lines_out), ("near duplicates", copies_out), ("decontamination", leaks_out), ("piece encoding", encoded)]
ORACLE_SQL = None  # training, string kernels, tiling and the vocabulary are not SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of a folder, each from what the one before has written."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name.replace(' ', '_')}")
    return STAGES[-1][1](spark, docs, sf_dir)
