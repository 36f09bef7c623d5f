"""Context atlas and hierarchical validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators import evidence as ev
from barline.operators import inference as inf
from barline.operators import paths


def context_atlas(records: DataFrame, reps: int = 500, low: int = 12, high: int = 486, seed: int = 20260825, strong: int = 100, minimum: int = 30) -> DataFrame:
    """Cells with statistics, drawdown, bootstrap bounds of large confirmation cells, and status."""
    rich = ev.enriched(records)
    keys = list(ev.ATLAS_CELL)
    cells = ev.yearly_cells(rich, keys).join(paths.drawdown(rich, keys, "outcome_pips"), keys)
    large = cells.filter((F.col("split") == "confirmation") & (F.col("n") >= strong)).select(*keys)
    sample = paths.ranked(rich.join(large, keys, "left_semi").select(*keys, "ts", "outcome_pips"), keys, ("ts",))
    bounds = inf.order_statistics(inf.bootstrap_means(sample, keys, "outcome_pips", reps, seed), keys, low, high)
    d = ev.with_median(cells.join(bounds, keys, "left"), rich, keys, "outcome_pips")
    return d.withColumn("status", ev.atlas_status(F.col("lower"), minimum, strong))


def ranked_contexts(atlas: DataFrame, n: int = 250) -> DataFrame:
    """The best confirmation contexts of each status, for contexts not to trade the worst ones."""
    judged = atlas.filter((F.col("split") == "confirmation") & (F.col("status") != "UNKNOWN"))
    sign = F.when(F.col("status") == "NO_TRADE", 1).otherwise(-1)
    order = [sign * F.round("expectancy", 6), sign * F.col("n"), *[F.col(k) for k in ev.ATLAS_CELL]]
    return ev.top_per(judged, ["status"], order, n)


def hierarchical_validation(
    records: DataFrame, discovery_n: int = 100, confirmation_n: int = 100, per_spec: int = 20, reps: int = 2000, low: int = 49, seed: int = 0
) -> DataFrame:
    """Contexts selected on discovery only, then judged on their confirmation rows."""
    cells = ev.hierarchy_cells(records)
    found = cells.filter((F.col("split") == "discovery") & (F.col("n") >= discovery_n) & ev.survives())
    order = [F.round("expectancy", 6).desc(), F.round("profit_factor", 6).desc_nulls_last(), F.col("n").desc(), F.col("key")]
    picked = ev.top_per(found, ["spec"], order, per_spec).select("spec", "key")
    judged = cells.filter((F.col("split") == "confirmation") & (F.col("n") >= confirmation_n)).join(F.broadcast(picked), ["spec", "key"])
    rows = ev.hierarchy_rows(records.filter(F.col("split") == "confirmation")).join(judged.select("spec", "key"), ["spec", "key"], "left_semi")
    sample = paths.ranked(rows.select("spec", "key", "ts", "pair", "outcome_pips"), ["spec", "key"])
    bounds = inf.order_statistics(inf.bootstrap_means(sample, ["spec", "key"], "outcome_pips", reps, seed), ["spec", "key"], low, reps - 1 - low)
    d = judged.join(bounds, ["spec", "key"], "left")
    return d.withColumn("status", ev.hierarchy_status(F.col("lower"), strong=confirmation_n, minimum=min(30, confirmation_n)))
