"""Non-live evaluation verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators import evidence as ev
from barline.operators import inference as inf
from barline.operators import paths
from barline.session import written


def non_live(rows: DataFrame, keys: Sequence[str], train: int, validation: int, step: int, costs: Sequence[float], reps: int = 2000, low: int = 24, seed: int = 0, capital: float = 20.0) -> DataFrame:
    """PASS if every slice of the tail, every cost and both bootstraps support a gain.

    The number of slices is the number of walk-forward folds; the slices themselves are equal parts of the
    rows after the first training window.  ``costs[0]`` is the base cost.
    """
    keys = list(keys)
    d = paths.ranked(rows.select(*keys, "ts", "pair", "outcome_pips"), keys)
    counts = d.groupBy(*keys).agg(F.max("n").alias("n"))
    folds = F.floor((F.col("n") - train - validation) / step) + 1
    tail = d.filter((F.col("n") >= train + validation) & (F.col("rn") >= train)).withColumn("folds", folds)
    tail = tail.withColumn("rn", F.col("rn") - train).withColumn("v", F.col("outcome_pips") - F.lit(float(costs[0])))
    tail = tail.withColumn("fold", F.least(F.floor(F.col("rn") / F.floor((F.col("n") - train) / F.col("folds"))), F.col("folds") - 1))
    tail = written(tail, "tail")
    stats = tail.groupBy(*keys, "fold").agg(F.avg("v").alias("e")).join(paths.drawdown(tail, [*keys, "fold"], "v"), [*keys, "fold"])
    stats = stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), F.bool_and(F.col("e") > 0).alias("folds_positive"), F.max("max_drawdown").alias("worst_drawdown"))
    mean = tail.groupBy(*keys).agg(F.avg("outcome_pips").alias("_m"))
    audit = inf.distribution_audit(tail.select(*keys, "rn", "v", "ts", "pair"), keys, "v", paths.drawdown(tail, keys, "v"), capital, reps, seed, low)
    out = (
        counts.join(stats, keys, "left").join(mean, keys, "left")
        .join(audit.select(*keys, "lower", "probability_positive", "ruin_probability"), keys, "left")
    )
    gates = {
        "folds_positive": F.col("folds_positive"),
        "stress_resilient": F.col("_m") - F.lit(float(max(costs))) > 0,
        "uncertainty_supportive": (F.col("lower") > 0) & (F.col("probability_positive") >= 0.95) & (F.col("ruin_probability") < 0.05),
    }
    return out.withColumns(ev.verdict(gates, F.col("n") >= train + validation)).drop("_m")
