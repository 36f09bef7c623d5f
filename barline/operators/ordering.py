"""Ordered work over long series without one task per series.

A series (one pair, one candidate) may hold a third of all rows, so a window over
``partitionBy(series)`` would put a third of the data into one task.  The helpers here number the
rows from per-block counts and then run bounded frames inside blocks of positions, with the few rows
a frame needs from the neighbouring block copied across (the halo).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_block(ts: str, block_s: int) -> Column:
    s = F.unix_seconds(F.col(ts))
    return s - F.pmod(s, F.lit(block_s))


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    block: Column,
    out: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based position in the series; ``block`` must be monotone in ``order``.

    Rows are ranked inside (keys, block); only one count per block crosses to the series level.
    """
    keys = list(keys)
    d = df.withColumn("_blk", block)
    counts = d.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(Window.partitionBy(*keys)).alias("_total")] if total else []
    offsets = counts.select(*keys, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), *extra)
    ranked = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy(*order)))
    joined = ranked.join(offsets, [*keys, "_blk"]).withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
    if total:
        joined = joined.withColumn(total, F.col("_total").cast("bigint"))
    return joined.drop("_blk", "_off", "_rn", "_total")


def in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    before: int,
    after: int,
    compute: Callable[[DataFrame, Callable[..., object]], DataFrame],
    block_rows: int = 4096,
) -> DataFrame:
    """Run bounded frames (at most ``before`` rows back, ``after`` ahead) block by block.

    ``compute(df, window)`` gets the frame factory ``window(lo, hi)``; called without bounds it is the
    plain ordered window for lag/lead.
    """
    size = max(block_rows, 2 * before, 2 * after)
    home = F.floor(F.col(pos) / F.lit(size)).cast("bigint")
    inside = F.col(pos) % F.lit(size)
    copies = F.filter(
        F.array(
            home,
            F.when(inside >= size - before, home + 1) if before else F.lit(None).cast("bigint"),
            F.when((inside < after) & (home > 0), home - 1) if after else F.lit(None).cast("bigint"),
        ),
        lambda c: c.isNotNull(),
    )
    d = df.withColumn("_home", home).withColumn("_wb", F.explode(copies))
    base = Window.partitionBy(*keys, "_wb").orderBy(pos)

    def window(lo: int | None = None, hi: int | None = None) -> object:
        return base if lo is None else base.rowsBetween(lo, hi)

    return compute(d, window).filter(F.col("_wb") == F.col("_home")).drop("_wb", "_home")


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    block: Column,
    out: str,
    value: Column,
    how: str = "sum",
    inclusive: bool = True,
) -> DataFrame:
    """Running sum or maximum over a long series in two levels: inside a block, plus the blocks before.

    ``block`` must be monotone in ``order``.  One row per block crosses to the series level.
    """
    keys = list(keys)
    fn = F.sum if how == "sum" else F.max
    last = 0 if inclusive else -1
    local = Window.partitionBy(*keys, "_rb").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    d = df.withColumn("_rb", block).withColumn("_value", value)
    blocks = d.groupBy(*keys, "_rb").agg(fn("_value").alias("_whole"))
    earlier = Window.partitionBy(*keys).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_rb", fn("_whole").over(earlier).alias("_before"))
    joined = d.withColumn("_local", fn("_value").over(local)).join(blocks, [*keys, "_rb"])
    if how == "sum":
        zero = F.lit(0)
        combined = F.coalesce(F.col("_local"), zero) + F.coalesce(F.col("_before"), zero)
    else:
        combined = F.greatest("_local", "_before")
    return joined.withColumn(out, combined).drop("_rb", "_value", "_local", "_before")
