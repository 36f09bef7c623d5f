"""Validated two-sided history of a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.labels import normal_symbol
from barline.operators.quality import integrity
from barline.operators.resample import side_alignment


def validated_history(sided: DataFrame, symbols: DataFrame, start: Column, end: Column, block: Column) -> DataFrame:
    """Resolve symbols, scan both sides of [start, end), and report integrity and alignment per pair."""
    asked = symbols.select(normal_symbol("symbol", "/_").alias("_s")).distinct()
    bars = sided.filter((F.col("ts") >= start) & (F.col("ts") < end)).withColumn("_s", normal_symbol("pair", "/_")).join(asked, "_s", "left_semi").drop("_s")
    sides = integrity(bars, ["pair", "timeframe", "offer_side"], block)
    both = sides.groupBy("pair").agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.bool_and("ok").alias("sides_ok"), F.count(F.lit(1)).alias("sides"))
    d = both.join(side_alignment(bars), "pair")
    return d.withColumn("ok", F.col("sides_ok") & F.col("aligned") & (F.col("sides") == 2))
