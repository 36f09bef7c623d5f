"""Discovery, selection, confirmation and certification of candidates.

All jobs work on a table of candidates at once.  ``hits`` is the table of their records: ``cand``, ts,
pair, horizon, outcome_pips, and whatever a job adds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.statistics import trade_statistics
from barline.operators import evidence as ev
from barline.operators import inference as inf
from barline.operators import paths
from barline.operators.ordering import time_block
from barline.session import written

POINT = ("horizon", "regime", "session", "pairset", "direction", "agreement_min", "distance_max")
CELL = ["horizon", "regime", "session", "pairset", "direction"]


@dataclass(frozen=True)
class Screen:
    """Admission rules of a discovery search."""

    samples: int = 150
    profit_factor: float = 1.10
    alpha: float = 0.05
    reps: int = 1000
    low: int = 25
    seed: int = 20260821
    keep: int = 25


@dataclass(frozen=True)
class Confirmation:
    """Gates of a confirmation job."""

    samples: int = 500
    folds: int = 4
    stress: tuple[float, ...] = (0.0, 0.2, 0.5, 1.0, 1.5)
    positive_pairs: int = 3
    pair_samples: int = 20
    largest_share: float = 0.80
    reps: int = 2000
    low: int = 24
    simulations: int = 5000
    capital: float = 20.0
    ruin_cost: float = 0.5
    seed: int = 20260826


@dataclass(frozen=True)
class Certification:
    """Gates of a purged walk-forward certification."""

    folds: int = 12
    trades: int = 500
    series: int = 3
    positive_series: int = 3
    series_trades: int = 20
    largest_share: float = 0.80
    recovery: float = 1.0
    alpha: float = 0.05
    reps: int = 2000
    low: int = 49
    seed: int = 2026091901


def candidate_id(columns: Sequence[str] = POINT) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in columns])


def no_worse(column: str, least: float) -> Column:
    return F.coalesce(F.col(column) >= least, F.lit(False))


def discovery(records: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """Two-stage search over the whole grid.

    Stage one sums every grid point from pre-summed cells and gives each selectable one a HAC
    p-value; stage two bootstraps only those with the profit factor and raw p-value.  Holm covers the whole
    selectable family.  ``outcome`` tells why a point is not selected.
    """
    found = records.filter(F.col("global_split") == "discovery").withColumn("pairset", F.lit("all"))
    family = ev.grid_cells(found, CELL).filter(F.col("n") >= screen.samples)
    family = family.withColumn("cand", candidate_id()).withColumn("cid", F.row_number().over(Window.orderBy(*POINT)))
    family = written(family, "discovery-grid")
    hits = ev.matching(found.select(*CELL, "agreement", "median_distance", "pair", "ts", "outcome_pips"), family.select(*POINT, "cid"), CELL)
    hits = written(hits.select("cid", "pair", "ts", "outcome_pips"), "discovery-hits")
    tests = inf.hac_pvalue(
        hits, ["cid"], "outcome_pips", order=("pair", "ts"), block=F.struct("pair", time_block("ts", paths.WEEK))
    )
    d = written(inf.adjust(family.join(tests.select("cid", "p_value"), "cid"), "p_value", ["cand"]), "discovery-family")
    strong = d.filter((F.col("profit_factor") >= screen.profit_factor) & (F.col("p_value") <= screen.alpha)).select("cid")
    sample = written(paths.ranked(hits.join(F.broadcast(strong), "cid", "left_semi"), ["cid"]), "discovery-sample")
    means = inf.bootstrap_means(sample, ["cid"], "outcome_pips", screen.reps, screen.seed)
    bounds = inf.order_statistics(means, ["cid"], screen.low, screen.reps - 1 - screen.low)
    d = d.join(bounds.select("cid", "lower", "upper"), "cid", "left")
    outcome = (
        F.when(~no_worse("profit_factor", screen.profit_factor), "failed profit factor")
        .when(F.col("p_value") > screen.alpha, "failed raw discovery HAC p-value prefilter")
        .when(F.col("p_holm") > screen.alpha, "failed discovery-family Holm-adjusted HAC p-value")
        .when(~F.coalesce(F.col("lower") > 0, F.lit(False)), "failed discovery bootstrap lower-tail admission")
        .otherwise("selected")
    )
    return d.withColumn("outcome", outcome)


def discovery_order() -> list[Column]:
    """Bootstrap low, profit factor, expectancy, count; the id breaks ties."""
    rounded = [F.round(c, 6).desc_nulls_last() for c in ("lower", "profit_factor", "expectancy")]
    return [*rounded, F.col("n").desc(), F.col("cand")]


def two_sided_discovery(records: DataFrame, screen: Screen = Screen(low=49, reps=2000), diversity: Confirmation = Confirmation()) -> DataFrame:
    """Horizon x k hypotheses of the two-sided study with diversity, HAC, Holm and both bootstraps."""
    keys = ["horizon", "k"]
    found = records.filter(F.col("global_split") == "discovery")
    stats = found.groupBy(*keys).agg(*trade_statistics("outcome_pips")).filter(F.col("n") >= screen.samples)
    tests = inf.hac_pvalue(found.join(stats.select(*keys), keys, "left_semi"), keys, "outcome_pips")
    pairs = ev.pair_diversity(found, keys, diversity.pair_samples, null_pf_counts=True)
    d = inf.adjust(stats.join(tests.select(*keys, "p_value"), keys), "p_value", keys).join(pairs, keys)
    robust = (F.col("positive_pairs") >= diversity.positive_pairs) & (F.col("largest_share") <= diversity.largest_share)
    d = written(d.withColumn("pair_robust", robust), "two-sided-family")
    strong = d.filter(F.col("pair_robust") & (F.col("profit_factor") >= screen.profit_factor) & (F.col("p_value") <= screen.alpha)).select(*keys)
    sample = written(paths.ranked(found.join(F.broadcast(strong), keys, "left_semi").select(*keys, "ts", "pair", "outcome_pips"), keys), "sample")
    low, high = screen.low, screen.reps - 1 - screen.low
    plain = inf.order_statistics(inf.bootstrap_means(sample, keys, "outcome_pips", screen.reps, screen.seed), keys, low, high)
    block = inf.order_statistics(inf.block_bootstrap_means(sample, keys, "outcome_pips", 5, screen.reps, screen.seed + 1), keys, low, high)
    d = d.join(plain.select(*keys, "lower"), keys, "left").join(block.select(*keys, F.col("lower").alias("block_lower")), keys, "left")
    both = F.coalesce((F.col("lower") > 0) & (F.col("block_lower") > 0), F.lit(False))
    outcome = (
        F.when(~F.col("pair_robust"), "failed discovery pair-diversity/concentration gate")
        .when(~no_worse("profit_factor", screen.profit_factor), "failed discovery profit-factor gate")
        .when(F.col("p_holm") > screen.alpha, "failed discovery-family Holm-adjusted HAC p-value")
        .when(~both, "failed ordinary/block bootstrap lower-tail gate")
        .otherwise("selected")
    )
    return d.withColumn("outcome", outcome)


def enriched_search(records: DataFrame, samples: int = 150, n: int = 10) -> DataFrame:
    """Grid search on the pair split without a direction axis; the best ``n`` by expectancy."""
    keys = ["horizon", "regime", "session", "pairset"]
    found = ev.in_pairset(records.filter(F.col("split") == "discovery"))
    cells = ev.grid_cells(found, keys).filter(F.col("n") >= samples).withColumn("cand", candidate_id([*keys, "agreement_min", "distance_max"]))
    return ev.top(cells, [F.round("expectancy", 6).desc(), F.round("profit_factor", 6).desc_nulls_last(), F.col("cand")], n)


def hits_of(records: DataFrame, candidates: DataFrame, split: str, split_column: str = "split", on: Sequence[str] = ("horizon", "regime", "session", "pairset")) -> DataFrame:
    """Records of each candidate in one split; candidates carry ``cand``."""
    r = ev.in_pairset(records.filter(F.col(split_column) == split))
    points = candidates.select("cand", *on, "agreement_min", "distance_max")
    return ev.matching(r, points, on)


def capacity(records: DataFrame, candidates: DataFrame, least: int = 100) -> DataFrame:
    """Candidates with their confirmation row count, counted without looking at any outcome."""
    n = hits_of(records, candidates, "confirmation").groupBy("cand").agg(F.count(F.lit(1)).alias("holdout_n"))
    d = candidates.join(n, "cand", "left").withColumn("holdout_n", F.coalesce("holdout_n", F.lit(0)))
    return d.withColumn("eligible", F.col("holdout_n") >= least)


def conditional_robustness(hits: DataFrame, samples: int = 100) -> DataFrame:
    """Eight gates over the confirmation rows of each finalist."""
    base = hits.groupBy("cand").agg(*trade_statistics("outcome_pips"))
    base = ev.with_path(base, hits, ["cand"], "outcome_pips")
    curve = ev.cost_curve(hits, ["cand"], (0.2, 0.5, 1.0)).groupBy("cand").pivot("model", ["0.2", "0.5", "1.0"]).agg(F.bool_and(ev.survives()))
    curve = curve.withColumnsRenamed({"0.2": "s02", "0.5": "s05", "1.0": "s10"})
    pairs = ev.pair_diversity(hits, ["cand"], 1)
    d = base.join(curve, "cand").join(pairs, "cand")
    gates = {
        "confirmation_pf_gt_1": F.col("profit_factor") > 1,
        "confirmation_expectancy_positive": F.col("expectancy") > 0,
        "confirmation_sample_min_100": F.col("n") >= samples,
        "stress_0_2_pips_positive": F.col("s02"),
        "stress_0_5_pips_positive": F.col("s05"),
        "stress_1_0_pips_positive": F.col("s10"),
        "positive_pair_count_min_2": F.col("positive_pairs") >= 2,
        "max_drawdown_recorded": F.col("max_drawdown").isNotNull(),
    }
    return d.withColumns(ev.verdict(gates, F.lit(True))).withColumn("promotion_eligible", F.col("state") == "PASS")


def survival_search(records: DataFrame, samples: int = 150, half_samples: int = 50, holdout: int = 100, years: int = 2, year_samples: int = 50, n: int = 20) -> DataFrame:
    """Pair-specific grid: stable positive years and both chronological halves positive on discovery."""
    keys = ["pair", "horizon", "regime", "session"]
    point = [*keys, "agreement_min", "distance_max"]
    found = records.filter(F.col("split") == "discovery")
    cells = ev.grid_cells(found, keys, ev.SURVIVAL_AGREEMENT_GRID).filter((F.col("n") >= samples) & ev.survives())
    cells = written(cells.withColumn("cand", candidate_id(point)), "survival-grid")
    hits = ev.matching(found, cells.select(*point, "cand"), keys)
    stable = hits.groupBy("cand", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("outcome_pips").alias("e")).groupBy("cand").agg(
        F.count_if((F.col("n") >= year_samples) & (F.col("e") > 0)).alias("positive_years")
    )
    half = paths.halves(hits.select("cand", "ts", "pair", "outcome_pips"), ["cand"]).groupBy("cand", "half").agg(*trade_statistics("outcome_pips"))
    half = half.groupBy("cand").agg(
        F.min("expectancy").alias("worst_half"), F.bool_and((F.col("n") >= half_samples) & ev.survives()).alias("halves_ok"), F.count(F.lit(1)).alias("halves")
    )
    confirm = records.filter(F.col("split") == "confirmation")
    room = ev.matching(confirm, cells.select(*point, "cand"), keys).groupBy("cand").agg(F.count(F.lit(1)).alias("holdout_n"))
    d = cells.join(stable, "cand").join(half, "cand").join(room, "cand")
    d = d.filter((F.col("positive_years") >= years) & F.col("halves_ok") & (F.col("halves") == 2) & (F.col("holdout_n") >= holdout))
    order = [F.round("worst_half", 6).desc(), F.round("expectancy", 6).desc(), F.round("profit_factor", 6).desc_nulls_last(), F.col("cand")]
    return ev.top(d, order, n)


def survival_promotion(records: DataFrame, finalists: DataFrame, samples: int = 100, years: int = 2, year_samples: int = 25) -> DataFrame:
    """Confirmation gates of the survival finalists."""
    keys = ["pair", "horizon", "regime", "session"]
    points = finalists.select("cand", *keys, "agreement_min", "distance_max")
    hits = ev.matching(records.filter(F.col("split") == "confirmation"), points, keys)
    base = hits.groupBy("cand").agg(*trade_statistics("outcome_pips"))
    stable = hits.groupBy("cand", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("outcome_pips").alias("e")).groupBy("cand").agg(
        F.count_if((F.col("n") >= year_samples) & (F.col("e") > 0)).alias("stable_years")
    )
    stress = ev.cost_curve(hits, ["cand"], (0.2, 0.5)).groupBy("cand").agg(F.bool_and(ev.survives()).alias("stress_ok"))
    d = points.select("cand").join(base, "cand", "left").join(stable, "cand", "left").join(stress, "cand", "left")
    gates = {
        "confirmation_exists": F.col("n") > 0,
        "confirmation_sample_min_100": F.col("n") >= samples,
        "confirmation_expectancy_positive": F.col("expectancy") > 0,
        "confirmation_pf_gt_1": F.col("profit_factor") > 1,
        "stress_positive": F.col("stress_ok"),
        "confirmation_temporally_stable": F.col("stable_years") >= years,
    }
    return d.withColumns(ev.verdict(gates, F.lit(True)))


def confirmation(hits: DataFrame, rules: Confirmation = Confirmation()) -> DataFrame:
    """Robustness verdict per candidate over its confirmation rows (ts, pair order)."""
    keys = ["cand"]
    rows = written(hits.select("cand", "ts", "pair", "outcome_pips"), "confirmation-rows")
    base = ev.with_path(rows.groupBy(*keys).agg(*trade_statistics("outcome_pips")), rows, keys, "outcome_pips")
    folds = paths.equal_folds(rows, keys, rules.folds).groupBy("cand", "fold").agg(F.avg("outcome_pips").alias("e")).groupBy("cand").agg(
        F.bool_and(F.col("e") > 0).alias("folds_positive")
    )
    stress = ev.cost_curve(rows, keys, rules.stress).groupBy(*keys).agg(F.bool_and(ev.survives()).alias("stress_ok"))
    pairs = ev.pair_diversity(rows, keys, rules.pair_samples)
    sample = written(paths.ranked(rows, keys), "sample")
    low, high = rules.low, rules.reps - 1 - rules.low
    plain = inf.order_statistics(inf.bootstrap_means(sample, keys, "outcome_pips", rules.reps, rules.seed), keys, low, high)
    block = inf.order_statistics(inf.block_bootstrap_means(sample, keys, "outcome_pips", 5, rules.reps, rules.seed + 1), keys, low, high)
    ruin = inf.ruin_probability(sample, keys, "outcome_pips", rules.capital, rules.simulations, rules.seed + 2, rules.ruin_cost)
    d = (
        base.join(folds, keys, "left").join(stress, keys).join(pairs, keys).join(plain.drop("upper"), keys, "left")
        .join(block.select("cand", F.col("lower").alias("block_lower")), keys, "left").join(ruin, keys, "left")
    )
    gates = {
        "sample": F.col("n") >= rules.samples,
        "expectancy_positive": F.col("expectancy") > 0,
        "profit_factor_gt_1": F.col("profit_factor") > 1,
        "chronological_fold_stability": F.col("folds_positive"),
        "stress_resilient": F.col("stress_ok"),
        "uncertainty_supportive": (F.least("lower", "block_lower") > 0) & (F.col("probability_positive") >= 0.95) & (F.col("ruin_probability") < 0.05),
        "positive_pairs": F.col("positive_pairs") >= rules.positive_pairs,
        "pair_concentration": F.col("largest_share") <= rules.largest_share,
    }
    return d.withColumns(ev.verdict(gates, F.col("n") >= rules.samples))


def frozen_drift(discovered: DataFrame, snapshot: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Compare the recomputed discovery statistics of each candidate with its stored snapshot."""
    s = snapshot.select("cand", F.col("n").alias("s_n"), F.col("expectancy").alias("s_e"), F.col("profit_factor").alias("s_pf"))
    d = discovered.join(s, "cand")
    same = (F.col("n") == F.col("s_n")) & (F.abs(F.col("expectancy") - F.col("s_e")) <= tolerance)
    return d.withColumn("unchanged", F.coalesce(same & (F.abs(F.col("profit_factor") - F.col("s_pf")) <= tolerance), F.lit(False)))


RUN = ["cand", "fold", "model"]


def certification_cells(hits: DataFrame, timeline: DataFrame, interval_s: int, rules: Certification = Certification(), models: dict[str, float] = ev.COST_MODELS) -> DataFrame:
    """Every candidate x purged run x cost model with statistics, HAC and Holm p-values, bootstraps and gates."""
    bounds = paths.purged_boundaries(timeline, rules.folds, interval_s)
    kept = paths.purged_folds(hits.select("cand", "ts", "pair", "horizon", "outcome_pips"), bounds, interval_s).filter(F.col("purge") == "kept")
    costs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(c)).alias("cost")) for m, c in models.items()])
    runs = kept.select("cand", "fold", "ts", "pair", "outcome_pips", F.explode(costs).alias("c"))
    runs = runs.select("cand", "fold", "c.model", "ts", "pair", (F.col("outcome_pips") - F.col("c.cost")).alias("outcome_pips"))
    runs = written(runs, "certification-runs")
    stats = ev.with_path(runs.groupBy(*RUN).agg(*trade_statistics("outcome_pips")), runs, RUN, "outcome_pips")
    tests = inf.adjust(inf.hac_pvalue(runs, RUN, "outcome_pips").select(*RUN, "p_value"), "p_value", ["fold", "model"], ["cand"])
    pairs = ev.pair_diversity(runs, RUN, rules.series_trades)
    sample = written(paths.ranked(kept.select(*RUN[:2], "ts", "pair", "outcome_pips"), RUN[:2]), "sample")
    low, high = rules.low, rules.reps - 1 - rules.low
    plain = inf.order_statistics_at_costs(inf.bootstrap_means(sample, RUN[:2], "outcome_pips", rules.reps, rules.seed), RUN[:2], low, high, models)
    block = inf.order_statistics_at_costs(inf.block_bootstrap_means(sample, RUN[:2], "outcome_pips", 5, rules.reps, rules.seed + 1), RUN[:2], low, high, models)
    d = (
        stats.join(tests.select(*RUN, "p_value", "p_holm"), RUN, "left").join(pairs, RUN).join(plain.drop("upper"), RUN, "left")
        .join(block.select(*RUN, F.col("lower").alias("block_lower")), RUN, "left")
    )
    gates = {
        "trades": F.col("n") >= rules.trades,
        "series": F.col("eligible_pairs") >= rules.series,
        "positive_series": F.col("positive_pairs") >= rules.positive_series,
        "concentration": F.col("largest_share") <= rules.largest_share,
        "expectancy_positive": F.col("expectancy") > 0,
        "profit_factor_gt_1": F.col("profit_factor") > 1,
        "drawdown_recovery": F.col("recovery_ratio") >= rules.recovery,
        "ordinary_bootstrap": F.col("lower") > 0,
        "block_bootstrap": F.col("block_lower") > 0,
        "probability_positive": F.col("probability_positive") >= 0.95,
        "holm": F.col("p_holm") <= rules.alpha,
    }
    return d.withColumns(ev.verdict(gates, F.lit(True))).withColumn("qualifies", F.col("state") == "PASS")


def variants(candidates: DataFrame) -> DataFrame:
    """Each candidate with its agreement or distance threshold moved by 5 and 10 percent, kept in range."""
    shift = F.explode(F.array(*[F.lit(x) for x in (-0.10, -0.05, 0.05, 0.10)]))
    a = candidates.withColumn("_d", shift).withColumn(
        "agreement_min", F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("agreement_min") * (1 + F.col("_d"))))
    )
    b = candidates.filter(F.col("distance_max").isNotNull()).withColumn("_d", shift).withColumn(
        "distance_max", F.greatest(F.lit(0.01), F.col("distance_max") * (1 + F.col("_d")))
    )
    moved = a.withColumn("_f", F.lit("agreement")).unionByName(b.withColumn("_f", F.lit("distance")))
    return moved.withColumn("base", F.col("cand")).withColumn("cand", F.concat_ws("~", "cand", "_f", F.col("_d").cast("string"))).drop("_d", "_f")


def variant_stability(hits: DataFrame, timeline: DataFrame, interval_s: int, rules: Certification = Certification(), models: dict[str, float] = ev.COST_MODELS) -> DataFrame:
    """Whether every variant of a base candidate keeps a gain in every run and overall, under every cost.

    ``hits`` carry ``base`` and the variant id ``cand``, matched on all records.
    """
    bounds = paths.purged_boundaries(timeline, rules.folds, interval_s)
    kept = paths.purged_folds(hits.select("base", "cand", "ts", "pair", "horizon", "outcome_pips"), bounds, interval_s).filter(F.col("purge") == "kept")
    good = (F.col("n") >= rules.trades) & ev.survives()
    per_run = ev.cost_curve(kept, ["base", "cand", "fold"], models).groupBy("base", "cand").agg(
        F.bool_and(good).alias("runs_ok"), F.count_distinct("fold").alias("runs")
    )
    whole = ev.cost_curve(hits, ["base", "cand"], models).groupBy("base", "cand").agg(F.bool_and(good).alias("whole_ok"))
    d = whole.join(per_run, ["base", "cand"], "left")
    ok = F.coalesce(F.col("whole_ok") & F.col("runs_ok") & (F.col("runs") == rules.folds), F.lit(False))
    return d.groupBy("base").agg(F.count(F.lit(1)).alias("variants"), F.bool_and(ok).alias("stable")).withColumnRenamed("base", "cand")


def certification(cells: DataFrame, stability: DataFrame, rules: Certification = Certification(), models: dict[str, float] = ev.COST_MODELS) -> DataFrame:
    """Final verdict per candidate from its cells: all runs qualify under all costs, and the variants hold.

    Fewer runs than required, or one with fewer than two rows, is INCOMPLETE.
    """
    runs = cells.groupBy("cand", "fold").agg(
        F.bool_and("qualifies").alias("run_ok"), F.count(F.lit(1)).alias("models"), F.max("n").alias("n"),
        F.min("eligible_pairs").alias("series"), F.min("positive_pairs").alias("positive"), F.bool_and(F.col("expectancy") > 0).alias("gain"),
        F.bool_and(F.col("recovery_ratio") >= rules.recovery).alias("recovers"), F.bool_and(F.coalesce(F.col("p_holm") <= rules.alpha, F.lit(False))).alias("holm"),
        F.bool_and(F.coalesce((F.col("lower") > 0) & (F.col("block_lower") > 0) & (F.col("probability_positive") >= 0.95), F.lit(False))).alias("boot"),
    )
    realistic = cells.filter(F.col("model") == list(models)[1]).groupBy("cand").agg(
        F.sum("net_profit").alias("net"), F.sum(F.col("win_rate") * F.col("n") * F.col("avg_win")).alias("_won"),
        F.sum(F.col("net_profit") - F.col("win_rate") * F.col("n") * F.col("avg_win")).alias("_lost"),
    )
    d = runs.groupBy("cand").agg(
        F.count_if(F.col("run_ok") & (F.col("models") == len(models)) & (F.col("n") >= rules.trades)).alias("qualifying_runs"),
        F.count(F.lit(1)).alias("runs"), F.min("n").alias("smallest_run"), F.min("series").alias("series"), F.min("positive").alias("positive"),
        *[F.bool_and(c).alias(c) for c in ("gain", "recovers", "holm", "boot")],
    ).join(realistic, "cand").join(stability, "cand", "left")
    gates = {
        "all_runs_qualify": F.col("qualifying_runs") == rules.folds,
        "execution_models": F.lit(len(models) >= 3),
        "runs": F.col("runs") == rules.folds,
        "trades_per_run": F.col("smallest_run") >= rules.trades,
        "series_per_run": F.col("series") >= rules.series,
        "positive_series_per_run": F.col("positive") >= rules.positive_series,
        "walk_forward_stability": F.col("gain"),
        "parameter_stability": F.col("stable"),
        "drawdown_recovery": F.col("recovers"),
        "bootstrap_robustness": F.col("boot"),
        "multiple_testing_holm": F.col("holm"),
        "execution_cost_robustness": F.col("gain"),
        "aggregate_positive": F.col("net") > 0,
        "aggregate_pf_gt_1": F.col("_won") > -F.col("_lost"),
    }
    return d.withColumns(ev.verdict(gates, (F.col("runs") == rules.folds) & (F.col("smallest_run") >= 2)))
