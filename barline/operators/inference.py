"""Bootstrap, ruin, HAC p-values, multiple testing and logistic calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.labels import col
from barline.functions.statistics import logistic, upper_tail
from barline.operators.draws import block_bootstrap_means, bootstrap_means, ruin_probability
from barline.operators.ordering import in_blocks
from barline.operators.paths import ranked
from barline.session import written


def order_statistics(means: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    """Values at two 0-based places of the sorted means, and the share of positive means."""
    w = Window.partitionBy(*keys).orderBy("mean", "rep")
    d = means.withColumn("_rn", F.row_number().over(w) - 1)
    return d.groupBy(*keys).agg(
        F.max(F.when(F.col("_rn") == low, F.col("mean"))).alias("lower"),
        F.max(F.when(F.col("_rn") == high, F.col("mean"))).alias("upper"),
        F.avg((F.col("mean") > 0).cast("double")).alias("probability_positive"),
    )


def order_statistics_at_costs(means: DataFrame, keys: Sequence[str], low: int, high: int, costs: dict[str, float], out: str = "model") -> DataFrame:
    """``order_statistics`` after each of several costs a value: they move every mean alike, so one resample serves all."""
    w = Window.partitionBy(*keys).orderBy("mean", "rep")
    d = means.withColumn("_rn", F.row_number().over(w) - 1).groupBy(*keys).agg(
        F.max(F.when(F.col("_rn") == low, F.col("mean"))).alias("_lower"), F.max(F.when(F.col("_rn") == high, F.col("mean"))).alias("_upper"),
        F.array(*[
            F.struct(F.lit(m).alias(out), F.lit(float(c)).alias("_cost"), F.avg((F.col("mean") > c).cast("double")).alias("probability_positive"))
            for m, c in costs.items()
        ]).alias("_at"),
    )
    d = d.select(*keys, "_lower", "_upper", F.inline("_at"))
    return d.select(*keys, out, (F.col("_lower") - F.col("_cost")).alias("lower"), (F.col("_upper") - F.col("_cost")).alias("upper"), "probability_positive")


# Places of the lower and upper bound among the sorted means, with the number of means.
INTERVALS = {
    "enriched": (1000, 25, 974),
    "atlas": (500, 12, 486),
    "hierarchy": (2000, 49, 1950),
    "non_live": (2000, 24, 1975),
    "two_sided": (2000, 49, 1950),
}


def hac_pvalue(rows: DataFrame, keys: Sequence[str], value: str, lags: int = 5, order: Sequence[str] = ("ts", "pair"), block: Column | None = None) -> DataFrame:
    """One-sided p-value of a positive mean under serial dependence (Bartlett weights).

    Autocovariance at a lag is averaged over the pairs it has.  Groups need more rows than lags.
    Ranks come from block counts and lags from blocks with a halo, so long groups stay split.
    """
    keys = list(keys)
    d = ranked(rows.withColumn("_v", col(value)), keys, order, block)
    means = d.groupBy(*keys).agg(F.avg("_v").alias("_mean"))
    d = d.filter((F.col("n") > lags) & (F.col("n") >= 2)).join(means, keys).withColumn("_c", F.col("_v") - F.col("_mean"))

    def compute(x: DataFrame, window) -> DataFrame:  # noqa: ANN001
        return x.withColumns({f"_p{k}": F.col("_c") * F.lag("_c", k).over(window()) for k in range(1, lags + 1)})

    d = in_blocks(d.select(*keys, "rn", "n", "_mean", "_c"), keys, "rn", lags, 0, compute)
    g = d.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("_mean").alias("mean"), F.avg(F.col("_c") * F.col("_c")).alias("_g0"),
        *[F.avg(f"_p{k}").alias(f"_g{k}") for k in range(1, lags + 1)],
    )
    variance = F.col("_g0")
    for k in range(1, lags + 1):
        variance = variance + 2.0 * (1.0 - k / (lags + 1.0)) * F.col(f"_g{k}")
    se = F.sqrt(F.greatest(variance, F.lit(0.0)) / F.col("n"))
    return g.select(*keys, "n", "mean", se.alias("se")).withColumn("p_value", upper_tail(F.col("mean"), F.col("se")))


def _over_all(order: Sequence[Column] = (), keys: Sequence[str] = ()) -> object:
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order) if order else Window.partitionBy(*(keys or [F.lit(0)]))


def adjust(tests: DataFrame, p: str, tie: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg adjusted p-values over each family of tests.

    A family is a search grid (thousands of rows); ``tie`` names it uniquely to order equal p-values.
    """
    up = _over_all([F.col(p), *[F.col(c) for c in tie]], keys)
    down = _over_all([F.col(p).desc(), *[F.col(c).desc() for c in tie]], keys)
    m = F.count(F.lit(1)).over(_over_all(keys=keys))
    d = tests.withColumn("_m", m).withColumn("_rn", F.row_number().over(up))
    one = F.lit(1.0)
    step_down = F.max(F.least(one, (F.col("_m") - F.col("_rn") + 1) * F.col(p))).over(up.rowsBetween(Window.unboundedPreceding, 0))
    step_up = F.min(F.least(one, F.col(p) * F.col("_m") / F.col("_rn"))).over(down.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumns(
        {"p_bonferroni": F.least(one, F.col(p) * F.col("_m")), "p_holm": step_down, "p_bh": step_up, "family_size": F.col("_m")}
    ).drop("_m", "_rn")


def distribution_audit(rows: DataFrame, keys: Sequence[str], value: str, drawdowns: DataFrame, capital: float = 20.0, reps: int = 2000, seed: int = 0, low: int = 24, cost: float = 0.0, simulations: int = 5000) -> DataFrame:
    """Bounds of the mean by both bootstraps, probability of a positive mean, drawdown and ruin, per group."""
    keys = list(keys)
    high = reps - 1 - low
    plain = order_statistics(bootstrap_means(rows, keys, value, reps, seed), keys, low, high)
    block = order_statistics(block_bootstrap_means(rows, keys, value, 5, reps, seed + 1), keys, low, high)
    ruin = ruin_probability(rows, keys, value, capital, simulations, seed + 2, cost)
    means = rows.groupBy(*keys).agg(F.avg(value).alias("mean"))
    b = block.select(*keys, F.col("lower").alias("block_lower"), F.col("upper").alias("block_upper"))
    return (
        means.join(plain, keys).join(b, keys).join(ruin, keys).join(drawdowns.select(*keys, "max_drawdown"), keys)
        .withColumn("ordinary_lower", F.col("lower")).withColumn("ordinary_upper", F.col("upper"))
        .withColumn("lower", F.least("ordinary_lower", "block_lower")).withColumn("upper", F.greatest("ordinary_upper", "block_upper"))
    )


# A cohort's table of distinct scores is fitted inside one row up to this many entries.
SCORES_PER_ROW = 10_000


def score_counts(rows: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    return rows.groupBy(*keys, F.col(score).cast("double").alias("_x"), F.col(label).cast("double").alias("_y")).agg(
        F.count(F.lit(1)).cast("double").alias("_n")
    )


def fit_logistic(rows: DataFrame, keys: Sequence[str], score: str, label: str, steps: int = 1200, rate: float = 0.05, least: int = 20) -> DataFrame:
    """Two-parameter logistic fit per cohort of ``least`` rows or more, by full-batch gradient descent from 0.

    Rows are first counted per (cohort, score, label).  Where every cohort has few distinct scores
    (checked), the descent runs inside one row per cohort; else each step is one aggregate over the
    counts and one gradient pair per cohort.
    """
    keys = list(keys)
    counts = written(score_counts(rows, keys, score, label), "score_counts")
    enough = counts.groupBy(*keys).agg(F.sum("_n").alias("_all")).filter(F.col("_all") >= least).drop("_all")
    counts = counts.join(enough, keys, "left_semi")
    widest = counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if widest > SCORES_PER_ROW:
        return _fit_stepwise(counts, keys, steps, rate)
    d = counts.groupBy(*keys).agg(F.collect_list(F.struct("_x", "_y", "_n")).alias("_s"), F.sum("_n").alias("n"))

    def gradient(m: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("ga"), F.lit(0.0).alias("gb"))

        def add(acc: Column, r: Column) -> Column:
            e = (logistic(m["a"] + m["b"] * r["_x"]) - r["_y"]) * r["_n"]
            return F.struct((acc["ga"] + e).alias("ga"), (acc["gb"] + e * r["_x"]).alias("gb"))

        return F.aggregate(F.col("_s"), zero, add)

    def step(state: Column, _: Column) -> Column:
        moved = F.transform(
            F.array(gradient(state)),
            lambda g: F.struct(
                (state["a"] - rate * g["ga"] / F.col("n")).alias("a"), (state["b"] - rate * g["gb"] / F.col("n")).alias("b")
            ),
        )
        return F.element_at(moved, 1)

    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    fitted = d.withColumn("_m", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))
    return fitted.select(*keys, F.col("_m.a").alias("intercept"), F.col("_m.b").alias("slope"), F.col("n").cast("bigint").alias("n"))


def _fit_stepwise(counts: DataFrame, keys: list[str], steps: int, rate: float) -> DataFrame:
    spark = counts.sparkSession
    first = counts.groupBy(*keys).agg(F.sum("_n").alias("n")).select(*keys, F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), "n")
    schema, model = first.schema, first.collect()
    for _ in range(steps):
        table = spark.createDataFrame(model, schema)
        error = (logistic(F.col("a") + F.col("b") * F.col("_x")) - F.col("_y")) * F.col("_n")
        g = counts.join(F.broadcast(table), keys).groupBy(*keys, "a", "b", "n").agg(F.sum(error).alias("ga"), F.sum(error * F.col("_x")).alias("gb"))
        model = g.select(
            *keys, (F.col("a") - rate * F.col("ga") / F.col("n")).alias("a"), (F.col("b") - rate * F.col("gb") / F.col("n")).alias("b"), "n"
        ).collect()
    out = spark.createDataFrame(model, schema)
    return out.select(*keys, F.col("a").alias("intercept"), F.col("b").alias("slope"), F.col("n").cast("bigint").alias("n"))
