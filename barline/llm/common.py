"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and text only, under fixed names; a null text is an empty one. Other columns, whatever their names, stay outside."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row where a single text is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Give the memory this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_REMEMBERED: list = []


def remembered(make: Callable) -> Callable:
    """``make(path)``, whose last results a worker keeps for later tasks of their kind; see ``tidy``."""
    kept = lru_cache(maxsize=2)(make)
    _REMEMBERED.append(kept)
    return kept


def forget() -> None:
    """Drop what this process remembers for tasks of other kinds."""
    if any(kept.cache_info().currsize for kept in _REMEMBERED):
        for kept in _REMEMBERED:
            kept.cache_clear()
        give_back()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which a worker gives the memory it no longer uses back, as it is kept for tasks of other kinds.

    Before it, the worker drops what it remembers for such tasks; with ``keep``, ``run`` is of the kind that remembers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            forget()
        yield from run(batches)
        give_back()

    return work


def most_frequent(counted: DataFrame, key: str, weight: str, rows: int, longest: int = 64) -> DataFrame:
    """The heaviest keys of at most ``longest`` bytes, ``rows`` at most: at most ``rows * (longest + 16)`` bytes, whatever the input.

    The weight from which keys are taken comes from their counts by sixteenths of powers of two, so no task sends more than its
    share of the answer.
    """
    short = counted.where(F.octet_length(key) <= longest).withColumn("_step", F.floor(F.log2(weight) * 16))
    steps = sorted(short.groupBy("_step").count().collect(), reverse=True)  # some thousand rows at most
    taken, least = 0, None
    for step, n in steps:
        taken += n
        if taken > rows:
            break
        least = step
    return short.where(F.lit(False) if least is None else F.col("_step") >= least).drop("_step")
