"""Evidence tables over target records: groups, grids, atlas cells, calibration, drift, gates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.labels import agreement_band, col, distance_band, hour_block, outcome_sign, pairsets, weekday_name
from barline.functions.statistics import profit_factor, ratio, trade_statistics, wilson, win_rate
from barline.operators.paths import drawdown, recovery
from barline.session import small_side

# The search grids.
AGREEMENT_GRID = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75)
DISTANCE_GRID = (None, 0.5, 1.0, 1.5, 2.0)
SURVIVAL_AGREEMENT_GRID = (0.50, 0.60, 0.70)
REGIMES = (
    "regime:breakout_up", "regime:breakout_down", "regime:high_vol_trend_up", "regime:high_vol_trend_down",
    "regime:high_volatility_range", "regime:trend_up", "regime:trend_down", "regime:range_low_vol", "regime:range_normal",
)
SESSIONS = ("asia", "london", "new_york", "rollover")
DIRECTIONS = ("long", "short")
CELL = ("horizon", "regime", "session", "direction")

# Execution cost models in pips.
COST_MODELS = {"base": 0.40, "realistic": 0.80, "stress": 1.50}


def explode_values(df: DataFrame, name: str, values: Sequence[object], kind: str) -> DataFrame:
    """Every row once per value of a short fixed list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])))


def exact_quantile(rows: DataFrame, keys: Sequence[str], value: str, p: float = 0.5, out: str = "median", margin: float = 0.0005) -> DataFrame:
    """Exact quantile (linear interpolation) per group without holding a group in one task.

    An approximate sketch brackets the quantile; rows below the bracket are only counted, and the few values
    inside are counted per value and summed in order.
    """
    keys = list(keys)
    v = F.col(value)
    sketch = F.percentile_approx(v, F.array(F.lit(max(p - margin, 0.0)), F.lit(min(p + margin, 1.0))), F.lit(10_000))
    bracket = rows.groupBy(*keys).agg(sketch.alias("_q"), F.count(v).alias("_n")).filter(F.col("_n") > 0)
    d = rows.join(bracket, keys)
    below = d.groupBy(*keys).agg(F.count_if(v < F.col("_q")[0]).alias("_below"), F.max("_n").alias("_n"))
    inside = d.filter((v >= F.col("_q")[0]) & (v <= F.col("_q")[1])).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.join(below, keys).withColumn("_cum", F.col("_below") + F.sum("_c").over(w))
    place = (F.col("_n") - 1) * F.lit(p)
    at = lambda i: F.min(F.when(F.col("_cum") > i, F.col("_v")))
    d = inside.groupBy(*keys).agg(at(F.floor(place)).alias("_lo"), at(F.ceil(place)).alias("_hi"), F.max(place - F.floor(place)).alias("_f"))
    return d.select(*keys, (F.col("_lo") + (F.coalesce("_hi", "_lo") - F.col("_lo")) * F.col("_f")).alias(out))


def probability_summary(value: str | Column, threshold: float = 0.0) -> list[Column]:
    v = col(value)
    rate, n = F.avg((v > threshold).cast("double")), F.count(v)
    low, high = wilson(rate, n)
    return [n.alias("n"), rate.alias("probability"), low.alias("ci_low"), high.alias("ci_high"), F.avg(v).alias("mean")]


def with_median(stats: DataFrame, rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return stats.join(exact_quantile(rows, keys, value), list(keys), "left")


def evaluation(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The record evaluation of the search: n, expectancy, profit factor, win rate with interval, median."""
    v = F.col(value)
    low, high = wilson(win_rate(v), F.count(v), clamp=False)
    stats = rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("expectancy"), profit_factor(v).alias("profit_factor"), win_rate(v).alias("win_rate"), low.alias("ci_low"), high.alias("ci_high")
    )
    return with_median(stats, rows, keys, value)


def filtered(records: DataFrame, split: str | None = None, distance_max: float | None = None, agreement_min: float = 0.0, split_column: str = "split") -> DataFrame:
    d = records.filter(F.col("agreement") >= agreement_min)
    if split:
        d = d.filter(F.col(split_column) == split)
    return d if distance_max is None else d.filter(F.col("median_distance") <= distance_max)


def with_path(stats: DataFrame, rows: DataFrame, keys: Sequence[str], value: str | Column, order: Sequence[str] = ("ts", "pair")) -> DataFrame:
    """Add drawdown, net profit and recovery ratio to a statistics table."""
    d = stats.join(drawdown(rows, keys, value, order), list(keys))
    return d.withColumn("recovery_ratio", recovery(F.col("net_profit"), F.col("max_drawdown")))


def grouped(records: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column], labels: Sequence[str]) -> DataFrame:
    """Statistics for several grouping keys in one pass (grouping sets); ``spec`` names the set of each row."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    cols = [[F.col(c) for c in s] for s in sets]
    d = records.groupingSets(cols, *[F.col(c) for c in names]).agg(F.grouping_id(*names).alias("_gid"), *aggregates)
    spec: Column | None = None
    for s, label in zip(sets, labels, strict=True):
        gid = sum((0 if c in s else 1) << (len(names) - 1 - i) for i, c in enumerate(names))
        hit = F.col("_gid") == gid
        spec = F.when(hit, label) if spec is None else spec.when(hit, label)
    return d.withColumn("spec", spec).drop("_gid")


def enriched(records: DataFrame) -> DataFrame:
    """Calendar fields, bands and outcome sign."""
    return records.withColumns(
        {
            "year": F.year("ts").cast("bigint"), "month": F.month("ts"), "weekday": weekday_name("ts"), "hour_utc": F.hour("ts"),
            "hour_block_utc": hour_block("ts"), "agreement_band": agreement_band("agreement"),
            "distance_band": distance_band("median_distance"), "outcome_sign": outcome_sign("outcome_pips"),
        }
    )


ATLAS_CELL = ("pair", "horizon", "regime", "session", "weekday", "agreement_band", "distance_band", "direction", "split")


def yearly_cells(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cell statistics with the number of observed and positive years: years first, then cells."""
    v = F.col("outcome_pips")
    years = records.groupBy(*keys, "year").agg(
        F.count(v).alias("_n"), F.sum(v).alias("_sum"), F.count_if(v > 0).alias("_wins"),
        F.sum(F.when(v > 0, v).otherwise(0.0)).alias("_gain"), F.sum(F.when(v < 0, -v).otherwise(0.0)).alias("_loss"),
    )
    return years.groupBy(*keys).agg(
        F.sum("_n").alias("n"), (F.sum("_sum") / F.sum("_n")).alias("expectancy"),
        ratio(F.sum("_gain"), F.sum("_loss")).alias("profit_factor"), (F.sum("_wins") / F.sum("_n")).alias("win_rate"),
        F.count_if(F.col("_sum") / F.col("_n") > 0).alias("positive_years"), F.count(F.lit(1)).alias("observed_years"),
    ).withColumn("stability", F.col("positive_years") / F.col("observed_years"))


def atlas_status(low: Column, minimum: int = 30, strong: int = 100) -> Column:
    n, e, pf = F.col("n"), F.col("expectancy"), F.col("profit_factor")
    return (
        F.when(n < minimum, "UNKNOWN")
        .when((e <= 0) | pf.isNull() | (pf <= 1), "NO_TRADE")
        .when((n >= strong) & (low.isNull() | (low > 0)) & (F.col("stability") >= 0.67), "STRONG_CONTEXT")
        .otherwise("WATCH_CONTEXT")
    )


def hierarchy_status(low: Column, minimum: int = 30, strong: int = 100) -> Column:
    n, e, pf = F.col("n"), F.col("expectancy"), F.col("profit_factor")
    solid = pf.isNotNull() & F.coalesce(low > 0, F.lit(False)) & (F.col("stability") >= 2.0 / 3.0)
    large = F.when(solid, "STRONG_CONTEXT").when((e > 0) | F.coalesce(pf > 1, F.lit(False)), "WATCH_CONTEXT").otherwise("NO_TRADE")
    return F.when(n >= strong, large).when((n >= minimum) & ((e <= 0) | F.coalesce(pf <= 1, F.lit(False))), "NO_TRADE").otherwise("UNKNOWN")


# The key sets of the hierarchical contexts.
HIERARCHIES = {
    "pair_horizon_regime_direction": ("pair", "horizon", "regime", "direction"),
    "pair_horizon_regime_session_direction": ("pair", "horizon", "regime", "session", "direction"),
    "pair_horizon_regime_session": ("pair", "horizon", "regime", "session"),
}


def hierarchy_rows(records: DataFrame) -> DataFrame:
    """Each record once per hierarchy, with the label and the key of its context."""
    keys = F.array(
        *[
            F.struct(F.lit(name).alias("spec"), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key"))
            for name, cols in HIERARCHIES.items()
        ]
    )
    return records.withColumn("_h", F.explode(keys)).select("*", "_h.spec", "_h.key").drop("_h")


def hierarchy_cells(records: DataFrame) -> DataFrame:
    """Cells of the three hierarchies per split: the finest key is summed first, the coarser ones from it."""
    v = F.col("outcome_pips")
    finest = records.groupBy("pair", "horizon", "regime", "session", "direction", "split", "year").agg(
        F.count(v).alias("_n"), F.sum(v).alias("_sum"), F.count_if(v > 0).alias("_wins"),
        F.sum(F.when(v > 0, v).otherwise(0.0)).alias("_gain"), F.sum(F.when(v < 0, -v).otherwise(0.0)).alias("_loss"),
    )
    sums = [F.sum(c).alias(c) for c in ("_n", "_sum", "_wins", "_gain", "_loss")]
    years = hierarchy_rows(finest).groupBy("spec", "key", "split", "year").agg(*sums)
    return years.groupBy("spec", "key", "split").agg(
        F.sum("_n").alias("n"), (F.sum("_sum") / F.sum("_n")).alias("expectancy"),
        ratio(F.sum("_gain"), F.sum("_loss")).alias("profit_factor"), (F.sum("_wins") / F.sum("_n")).alias("win_rate"),
        F.count_if(F.col("_sum") / F.col("_n") > 0).alias("positive_years"), F.count(F.lit(1)).alias("observed_years"),
    ).withColumn("stability", F.col("positive_years") / F.col("observed_years"))


def candidate_grid(
    spark: SparkSession, horizons: Sequence[int], agreements: Sequence[float] = AGREEMENT_GRID, distances: Sequence[float | None] = DISTANCE_GRID,
    regimes: Sequence[str] = REGIMES, sessions: Sequence[str] = SESSIONS, pairset_names: Sequence[str] = ("all",), directions: Sequence[str] | None = DIRECTIONS,
) -> DataFrame:
    """All grid points, by chained explodes of short fixed lists."""
    d = spark.range(1).select(F.lit(1).alias("_"))
    d = explode_values(d, "horizon", horizons, "bigint")
    d = explode_values(d, "agreement_min", agreements, "double")
    d = explode_values(d, "distance_max", distances, "double")
    d = explode_values(d, "regime", regimes, "string")
    d = explode_values(d, "session", sessions, "string")
    d = explode_values(d, "pairset", pairset_names, "string")
    if directions:
        d = explode_values(d, "direction", directions, "string")
    return d.drop("_")


def in_pairset(records: DataFrame) -> DataFrame:
    return records.withColumn("pairset", F.explode(pairsets("pair")))


def grid_cells(
    records: DataFrame, keys: Sequence[str], agreements: Sequence[float] = AGREEMENT_GRID, distances: Sequence[float | None] = DISTANCE_GRID
) -> DataFrame:
    """Count, sum, wins, gains and losses of every grid point.

    A record meets all thresholds below its agreement and above its distance.  Records are therefore
    summed once per (cell, highest agreement threshold met, lowest distance threshold met); only
    these few sums are copied to the grid points, not the records.
    """
    caps = sorted(d for d in distances if d is not None)
    level = reduce(lambda a, b: a + b, [(F.col("agreement") >= a).cast("int") for a in sorted(agreements)])
    reach = reduce(lambda a, b: a + b, [(F.col("median_distance") > c).cast("int") for c in caps]) if caps else F.lit(0)
    v = F.col("outcome_pips")
    sums = records.withColumns({"_level": level, "_reach": reach}).filter("_level > 0").groupBy(*keys, "_level", "_reach").agg(
        F.count(v).alias("_n"), F.sum(v).alias("_sum"), F.count_if(v > 0).alias("_wins"),
        F.sum(F.when(v > 0, v).otherwise(0.0)).alias("_gain"), F.sum(F.when(v < 0, -v).otherwise(0.0)).alias("_loss"),
    )
    ordered = F.array(*[F.lit(float(a)) for a in sorted(agreements)])
    limits = [(F.lit(i), F.lit(c).cast("double")) for i, c in enumerate(caps)]
    if None in distances:
        limits.append((F.lit(len(caps)), F.lit(None).cast("double")))
    options = F.array(*[F.struct(i.alias("i"), c.alias("distance_max")) for i, c in limits])
    points = sums.withColumn("agreement_min", F.explode(F.slice(ordered, F.lit(1), F.col("_level")))).withColumn(
        "_d", F.explode(F.filter(options, lambda o: o["i"] >= F.col("_reach")))
    ).withColumn("distance_max", F.col("_d.distance_max"))
    return points.groupBy(*keys, "agreement_min", "distance_max").agg(
        F.sum("_n").alias("n"), (F.sum("_sum") / F.sum("_n")).alias("expectancy"),
        ratio(F.sum("_gain"), F.sum("_loss")).alias("profit_factor"), (F.sum("_wins") / F.sum("_n")).alias("win_rate"),
    )


def matching(records: DataFrame, candidates: DataFrame, on: Sequence[str]) -> DataFrame:
    """Records of each candidate: equal keys, agreement at least and distance at most the candidate's.

    Records already carry ``pairset``.  Candidates are a grid or a selection from it; their number is checked.
    """
    hit = (F.col("agreement") >= F.col("agreement_min")) & (F.col("distance_max").isNull() | (F.col("median_distance") <= F.col("distance_max")))
    return records.join(small_side(candidates), list(on)).filter(hit)


def calibration_bins(rows: DataFrame, keys: Sequence[str], probability: str, label: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last closed: count, mean probability, rate, summed squared error."""
    p, y = F.col(probability), F.col(label).cast("double")
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("bigint")
    return rows.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_probability"), F.avg(y).alias("rate"), F.sum((p - y) * (p - y)).alias("squared_error")
    )


def calibration(binned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brier score and expected calibration error from the bins."""
    n = F.sum("n")
    gap = F.abs(F.col("mean_probability") - F.col("rate")) * F.col("n")
    return binned.groupBy(*keys).agg(n.alias("n"), (F.sum("squared_error") / n).alias("brier"), (F.sum(gap) / n).alias("ece"))


def drift(rows: DataFrame, keys: Sequence[str], window: str, value: str, mean_shift: float = 0.5, ratio_limit: float = 1.5, missing_limit: float = 0.1) -> DataFrame:
    """Shift of mean, spread and missing share between the ``reference`` and ``current`` windows; each needs two values."""
    v = F.col(value)
    ref, cur = F.col(window) == "reference", F.col(window) == "current"
    d = rows.groupBy(*keys).agg(
        F.avg(F.when(ref, v)).alias("_rm"), F.avg(F.when(cur, v)).alias("_cm"),
        F.stddev_pop(F.when(ref, v)).alias("_rs"), F.stddev_pop(F.when(cur, v)).alias("_cs"),
        F.count(F.when(ref, v)).alias("_rn"), F.count(F.when(cur, v)).alias("_cn"), F.count_if(ref).alias("_rt"), F.count_if(cur).alias("_ct"),
    ).filter((F.col("_rn") >= 2) & (F.col("_cn") >= 2))
    vol = F.when(F.col("_rs") > 0, F.col("_cs") / F.col("_rs")).when(F.col("_cs") > 0, F.lit(float("inf"))).otherwise(1.0)
    missing = lambda n, t: 1 - F.col(n) / F.col(t)
    d = d.withColumns(
        {
            "mean_shift": F.abs(F.col("_cm") - F.col("_rm")), "volatility_ratio": vol,
            "missing_shift": F.abs(missing("_cn", "_ct") - missing("_rn", "_rt")),
        }
    )
    flag = (F.col("mean_shift") >= mean_shift) | (F.col("volatility_ratio") >= ratio_limit) | (F.col("missing_shift") >= missing_limit)
    return d.withColumn("drift", flag).select(*keys, "mean_shift", "volatility_ratio", "missing_shift", "drift")


def co_moments(rows: DataFrame, on: Sequence[str], member: str, value: str) -> DataFrame:
    """(member_a, member_b, n, sa, sb, saa, sbb, sab): sums over the keys that two members share, both ways round and with themselves.

    The values of a key meet as one vector; a task turns its vectors into Gram matrices and sends one row per two members, so no
    pair of values is ever a row.  A key holds at most one value per member.
    """
    d = rows.filter(F.col(value).isNotNull()).groupBy(*on).agg(F.collect_list(F.struct(F.col(member).cast("string").alias("m"), F.col(value).cast("double").alias("v"))).alias("_values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        place: dict[str, int] = {}
        sums = np.zeros((6, 0, 0))
        for batch in batches:
            lists = batch.column("_values")
            flat, key = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            own = flat.field("m").dictionary_encode()
            for m in own.dictionary.to_pylist():
                if m not in place:
                    place[m] = len(names)
                    names.append(m)
            if len(names) > sums.shape[1]:
                grown = np.zeros((6, len(names), len(names)))
                grown[:, : sums.shape[1], : sums.shape[1]] = sums
                sums = grown
            column = np.array([place[m] for m in own.dictionary.to_pylist()], dtype=np.int64)[own.indices.to_numpy()]
            values, there = np.zeros((batch.num_rows, len(names))), np.zeros((batch.num_rows, len(names)))
            values[key, column], there[key, column] = flat.field("v").to_numpy(), 1.0
            squares = values * values
            sums += np.stack([there.T @ there, values.T @ there, there.T @ values, squares.T @ there, there.T @ squares, values.T @ values])
        a, b = np.nonzero(sums[0])
        label = pa.array(names, pa.string())
        yield pa.record_batch([label.take(pa.array(a)), label.take(pa.array(b)), pa.array(sums[0, a, b].astype(np.int64)), *[pa.array(s[a, b]) for s in sums[1:]]], names=["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])

    parts = d.select("_values").mapInArrow(run, "a string, b string, n long, sa double, sb double, saa double, sbb double, sab double")
    return parts.groupBy(F.col("a").alias(f"{member}_a"), F.col("b").alias(f"{member}_b")).agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])


def correlation_matrix(rows: DataFrame, on: Sequence[str], member: str, value: str, least: int = 1, constant: float | None = 0.0) -> DataFrame:
    """Correlation of every two members over the keys they share, both ways round, and 1 on the diagonal of varying members.

    Values are taken from their member's mean before they are summed, which changes no correlation and keeps the sums exact;
    a side without variance gives ``constant``, fewer than ``least`` keys give null.
    """
    means = rows.groupBy(F.col(member).alias("_m")).agg(F.avg(value).alias("_mean"), F.avg(F.col(value) * F.col(value)).alias("_square"))
    centred = rows.join(means.select("_m", "_mean"), F.col(member) == F.col("_m")).withColumn("_c", F.col(value) - F.col("_mean"))
    d = co_moments(centred, on, member, "_c")
    for side in "ab":
        d = d.join(means.select(F.col("_m").alias(f"{member}_{side}"), F.col("_square").alias(f"_scale_{side}")), f"{member}_{side}")
    n = F.col("n")
    spread = lambda x: F.greatest(F.lit(0.0), F.col(f"s{x}{x}") - F.col(f"s{x}") * F.col(f"s{x}") / n)
    varies = (spread("a") > n * F.col("_scale_a") * 1e-24) & (spread("b") > n * F.col("_scale_b") * 1e-24)
    r = (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(spread("a") * spread("b"))
    r = F.when(n < least, None).when(varies, F.when(F.col(f"{member}_a") == F.col(f"{member}_b"), 1.0).otherwise(r)).otherwise(F.lit(constant).cast("double"))
    return d.select(f"{member}_a", f"{member}_b", r.alias("r"), "n")


def pair_diversity(records: DataFrame, keys: Sequence[str], least: int = 20, null_pf_counts: bool = False) -> DataFrame:
    """Pairs with enough rows, pairs with a gain, and the largest pair's share of the rows."""
    p = records.groupBy(*keys, "pair").agg(*trade_statistics("outcome_pips"))
    good = F.coalesce(F.col("profit_factor") > 1, F.lit(null_pf_counts)) & (F.col("expectancy") > 0)
    return p.groupBy(*keys).agg(
        F.count_if(F.col("n") >= least).alias("eligible_pairs"), F.count_if((F.col("n") >= least) & good).alias("positive_pairs"),
        (F.max("n") / F.sum("n")).alias("largest_share"),
    )


def stability_score(value: str | Column) -> Column:
    """Share of positive values; 0 if all are zero; null for none."""
    v = col(value)
    return F.when(F.avg(F.abs(v)) == 0, 0.0).otherwise(F.avg((v > 0).cast("double")))


def perturbed(base: Column, changes: Sequence[float] = (-0.10, -0.05, 0.0, 0.05, 0.10)) -> Column:
    return F.array(*[base * (1.0 + d) for d in changes])


def cost_curve(records: DataFrame, keys: Sequence[str], costs: dict[str, float] | Sequence[float]) -> DataFrame:
    """Trade statistics after each cost, in one pass over the records.

    Expectancy shifts by the cost; gains and losses are conditional sums per cost.
    """
    named = costs if isinstance(costs, dict) else {str(c): c for c in costs}
    v = F.col("outcome_pips")
    aggs = []
    for i, cost in enumerate(named.values()):
        net = v - cost
        aggs += [
            F.avg(net).alias(f"e{i}"), win_rate(net).alias(f"w{i}"), profit_factor(net).alias(f"p{i}"),
        ]
    d = records.groupBy(*keys).agg(F.count(v).alias("n"), *aggs)
    rows = [
        F.struct(F.lit(name).alias("model"), F.lit(float(cost)).alias("cost"), F.col(f"e{i}").alias("expectancy"),
                 F.col(f"w{i}").alias("win_rate"), F.col(f"p{i}").alias("profit_factor"))
        for i, (name, cost) in enumerate(named.items())
    ]
    return d.select(*keys, "n", F.explode(F.array(*rows)).alias("r")).select(*keys, "n", "r.*")


def survives(expectancy: str = "expectancy", pf: str = "profit_factor") -> Column:
    """Positive expectancy and a profit factor above 1."""
    return (F.col(expectancy) > 0) & F.coalesce(F.col(pf) > 1, F.lit(False))


def expert_consensus(votes: DataFrame, keys: Sequence[str], weight: Column | None = None, confidence: float = 0.65, disagreement: float = 0.25) -> DataFrame:
    """Weighted vote of confident directional experts; abstains without them or on too much disagreement.

    Weights are added as decimals of 12 places, so a share that lies on the threshold does not depend on the order of the votes;
    a weight that is no finite number adds nothing.
    """
    ok = (F.col("confidence") >= confidence) & (F.col("direction") != "NO_TRADE")
    w = (F.col("confidence") if weight is None else weight).try_cast("decimal(28,12)")
    d = votes.groupBy(*keys).agg(
        F.count_if(ok).alias("eligible"),
        F.coalesce(F.sum(F.when(ok & (F.col("direction") == "BUY"), w)), F.lit(0)).alias("buy"),
        F.coalesce(F.sum(F.when(ok & (F.col("direction") == "SELL"), w)), F.lit(0)).alias("sell"),
    )
    d = d.withColumn("_total", F.nullif((F.col("buy") + F.col("sell")).cast("double"), F.lit(0.0)))
    share = lambda side: side.cast("double") / F.col("_total")
    d = d.withColumn("disagreement", F.coalesce(share(F.least("buy", "sell")), F.lit(1.0))).withColumn("share", share(F.greatest("buy", "sell"))).drop("_total")
    reason = (
        F.when(F.col("eligible") == 0, "no sufficiently confident directional expert")
        .when(F.col("disagreement") > disagreement, "expert disagreement exceeds threshold")
        .otherwise("dominant expert consensus")
    )
    d = d.withColumn("reason", reason)
    route = F.col("reason") == "dominant expert consensus"
    side = F.when(F.col("buy") > F.col("sell"), "BUY").otherwise("SELL")
    return d.withColumns(
        {
            "action": F.when(route, "ROUTE").otherwise("ABSTAIN"), "direction": F.when(route, side),
            "confidence": F.when(route, F.coalesce("share", F.lit(0.0))).otherwise(0.0),
        }
    )


def domain_consensus(votes: DataFrame, keys: Sequence[str], quality: Column, confidence: float = 0.65, disagreement: float = 0.25, floor: float = 0.70) -> DataFrame:
    """Consensus weighted by evidence strength; low context quality overrides it; confidence stays below .99."""
    d = expert_consensus(votes, keys, F.col("confidence") * F.col("strength"), confidence, 2.0)
    d = d.withColumn("quality", quality)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("quality") <= 0, "context_quality_zero"),
            F.when(F.col("eligible") == 0, "no_sufficiently_confident_experts"),
            F.when((F.col("eligible") > 0) & (F.col("disagreement") > disagreement), "expert_disagreement"),
            F.when((F.col("eligible") > 0) & (F.col("quality") < floor), "context_quality_below_operating_floor"),
        )
    )
    trade = (F.col("eligible") > 0) & (F.col("disagreement") <= disagreement) & (F.col("quality") >= floor)
    side = F.when(F.col("buy") > F.col("sell"), "BUY").otherwise("SELL")
    return d.withColumn("reasons", reasons).withColumn("consensus", F.when(trade, side).otherwise("NO_TRADE")).withColumn(
        "confidence", F.when(trade, F.least(F.lit(0.99), "share")).otherwise(0.0)
    )


def verdict(gates: dict[str, Column], enough: Column) -> dict[str, Column]:
    """All gates as one struct; too small a sample is INCOMPLETE, else PASS only if every gate holds."""
    closed = {name: F.coalesce(c, F.lit(False)) for name, c in gates.items()}
    passed = reduce(lambda a, b: a & b, closed.values())
    return {
        "gates": F.struct(*[c.alias(name) for name, c in closed.items()]),
        "failed": F.array_compact(F.array(*[F.when(~c, name) for name, c in closed.items()])),
        "state": F.when(~F.coalesce(enough, F.lit(False)), "INCOMPLETE").when(passed, "PASS").otherwise("FAIL"),
    }


def time_sets(rows: DataFrame, member: str, interval_s: int) -> DataFrame:
    """(member, bucket, times): the times of each member as bitmaps of 32,768 slots of an interval."""
    slot = F.floor(F.unix_seconds("ts") / interval_s)
    return rows.groupBy(member, F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("times"))


def time_set_sizes(sets: DataFrame, member: str) -> DataFrame:
    """Times common to every two members and those of either alone.

    The bitmaps of two members meet by their bucket and are combined by an aggregate: 4 kB a side and bucket, whatever the times
    in it.  A row of its size joins each member in a bucket of its own, so that members without a common time meet too.
    """
    none = F.lit(None)
    sizes = sets.groupBy(member).agg(F.sum(F.bitmap_count("times")).alias("n"))
    every = sets.select(member, "bucket", "times", none.cast("bigint").alias("n")).unionByName(sizes.select(member, F.lit(-1).cast("bigint").alias("bucket"), none.cast("binary").alias("times"), "n"))
    a, b = (every.select("bucket", F.col(member).alias(f"{member}_{x}"), F.col("times").alias(f"_t{x}"), F.col("n").alias(f"_n{x}")) for x in "ab")
    pair = [f"{member}_a", f"{member}_b"]
    met = a.join(b, "bucket").filter(F.col(pair[0]) < F.col(pair[1])).select(*pair, "bucket", "_na", "_nb", F.explode(F.array("_ta", "_tb")).alias("times"))
    both = met.groupBy(*pair, "bucket").agg(
        F.when(F.col("bucket") >= 0, F.bitmap_count(F.bitmap_and_agg("times"))).otherwise(0).alias("_common"), F.max("_na").alias("_na"), F.max("_nb").alias("_nb")
    )
    sums = both.groupBy(*pair).agg(F.sum("_common").alias("common"), F.max("_na").alias("_na"), F.max("_nb").alias("_nb"))
    return sums.select(*pair, "common", (F.col("_na") - F.col("common")).alias("only_a"), (F.col("_nb") - F.col("common")).alias("only_b"))


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows: a partial top-n per task, then one merge."""
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
