"""Leakage-safe nearest neighbours: for each target, the closest of the ``history`` states before it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barline.functions.labels import momentum_direction, pip_size, regime, session_label
from barline.functions.prices import net_move
from barline.operators.features import DISTANCE_FEATURES, contiguous, rolling_scaler, state_columns
from barline.operators.ordering import in_blocks, time_block, with_positions
from barline.operators.outcomes import forward_columns, long_move, short_move
from barline.session import Study, spread


def add(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def zscore_distance(pairs: Sequence[tuple[Column, Column, Column]]) -> Column:
    """sqrt(mean((a-b)/std)^2) over the features present on both sides; infinite with none."""
    terms = [F.coalesce(((a - b) / s) * ((a - b) / s), F.lit(0.0)) for a, b, s in pairs]
    used = [(a.isNotNull() & b.isNotNull() & s.isNotNull()).cast("int") for a, b, s in pairs]
    n = add(used)
    return F.when(n == 0, F.lit(float("inf"))).otherwise(F.sqrt(add(terms) / n))


def relative_distance(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """sqrt of the summed squared relative differences."""
    terms = []
    for a, b in pairs:
        d = (a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))
        terms.append(d * d)
    return F.sqrt(add(terms))


def study_states(bars: DataFrame, study: Study, gap_free: bool = True) -> DataFrame:
    """States (on gap-free lookbacks only, unless told otherwise) with their forward moves.

    ``spos`` numbers these states per pair; ``pos`` stays the bar position.
    """

    def compute(d: DataFrame, window: Callable[..., object]) -> DataFrame:
        flags = contiguous(window, study.interval_s, study.lookback, study.max_horizon)
        d = d.withColumn("_broken", flags.pop("_broken")).withColumns(flags)
        d = d.withColumns(state_columns(window, study.lookback))
        for h in study.horizons:
            d = d.withColumns(forward_columns(window, h))
            d = d.withColumn(f"end_{h}", F.lead("ts", h).over(window()))
        return d

    d = in_blocks(bars, ["pair"], "pos", study.lookback + 1, study.max_horizon, compute, study.block_rows)
    d = d.filter("back_ok") if gap_free else d.filter(F.col("pos") >= study.lookback)
    moves = [m for h in study.horizons for m in (long_move(h).alias(f"long_{h}"), short_move(h).alias(f"short_{h}"))]
    d = d.select(
        "pair", "ts", "pos", "bars", "ahead_ok", *DISTANCE_FEATURES, "breakout", *moves, *[f"end_{h}" for h in study.horizons]
    )
    block = time_block("ts", study.interval_s * study.block_rows)
    return with_positions(d, ["pair"], ["ts"], block, out="spos")


def volatility_z(mean: Column, std: Column, value: Column) -> Column:
    """Deviation of the current volatility from its history; 0 where the history is constant."""
    return F.coalesce((value - mean) / F.nullif(std, F.lit(0.0)), F.lit(0.0))


def targets(states: DataFrame, study: Study) -> DataFrame:
    """Sampled decision times with scaler, direction, regime and session."""
    scaled = rolling_scaler(states, ["pair"], "spos", DISTANCE_FEATURES, study.history, study.block_rows, zero=0.0)
    t = scaled.filter((F.col("spos") - study.history) % study.stride == 0)
    z = volatility_z(F.col("mean_volatility"), F.col("std_volatility"), F.col("volatility"))
    return (
        t.withColumn("vol_z", z)
        .withColumn("regime", F.concat(F.lit("regime:"), regime(F.col("trend"), F.col("trend_strength"), F.col("vol_z"), F.col("breakout"))))
        .withColumn("direction", momentum_direction("momentum"))
        .withColumn("session", session_label("ts"))
        .withColumns({f"std_{f}": F.when(F.col(f"std_{f}") == 0, 1.0).otherwise(F.col(f"std_{f}")) for f in DISTANCE_FEATURES})
    )


LEAST_BLOCK = 1024  # positions: smaller blocks are more groups than work
SCANNED = 256  # states judged at once


def block_size(study: Study, block: int | None = None) -> int:
    return block or max(study.history, LEAST_BLOCK)


def closest(target: np.ndarray, weight: np.ndarray, axis: int, axis_values: np.ndarray, values: np.ndarray, positions: np.ndarray, low: int, high: int, k: int, complete: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of the states at positions low to high - 1: their rows and distances, nearest first, ties by position.

    States lie in the order of one feature, ``axis``.  The scan goes outwards from the target's value and ends on a side where
    that feature alone is farther away than the k-th best so far; only the best ``k`` are kept between steps.
    """
    start = int(np.searchsorted(axis_values, target[axis]))
    left, right, step = start, start, max(SCANNED, 2 * k)
    rows, distances = np.zeros(0, dtype=np.int64), np.zeros(0)
    worst = np.inf
    while left > 0 or right < len(positions):
        found = []
        if right < len(positions):
            found.append(np.arange(right, min(len(positions), right + step)))
            right = min(len(positions), right + step)
        if left > 0:
            found.append(np.arange(max(0, left - step), left))
            left = max(0, left - step)
        at = np.concatenate(found)
        at = at[(positions[at] >= low) & (positions[at] < high)]
        total = np.zeros(len(at))
        used = np.zeros(len(at))
        for f in range(len(target)):
            if complete:
                gap = target[f] - values[f][at]
                total += gap * gap * weight[f]
            else:
                gap = (target[f] - values[f][at]) / weight[f]
                known = ~np.isnan(gap)
                total += np.where(known, gap * gap, 0.0)
                used += known
        if not complete:
            with np.errstate(divide="ignore", invalid="ignore"):
                total = np.where(used > 0, total / used, np.inf)
        rows, distances = np.concatenate([rows, at]), np.concatenate([distances, np.sqrt(total)])
        if len(rows) > k:
            best = np.lexsort((positions[rows], distances))[:k]
            rows, distances = rows[best], distances[best]
        if len(rows) >= k and complete:
            worst = distances.max()
            # one term of the sum is never more than the sum, so nothing beyond is as near as the k-th
            if right < len(positions) and (gap := target[axis] - axis_values[right]) * gap * weight[axis] > worst * worst * (1 + 1e-12):
                right = len(positions)
            if left > 0 and (gap := target[axis] - axis_values[left - 1]) * gap * weight[axis] > worst * worst * (1 + 1e-12):
                left = 0
        step *= 2
    best = np.lexsort((positions[rows], distances))[:k]
    return rows[best], distances[best]


def nearest(
    states: DataFrame,
    targets: DataFrame,
    study: Study,
    k: int,
    block: int | None = None,
    carry: Sequence[str] = (),
    complete: bool = True,
) -> DataFrame:
    """The ``k`` closest states among the ``history`` before each target; ties keep time order.

    A range join on positions as an equi-join on blocks: a state at ``p`` can only serve targets in
    (p, p+history], so it is copied to the blocks of that span.  A block's targets and states meet in one task, some
    block and history positions of each, and only the ``k`` found leave it: candidates are neither made rows nor sorted.
    Smaller blocks mean more copies and more tasks.  ``complete`` states that no feature is null, as for
    states of valid bars: the distance is then a plain weighted sum, and the scan of a target is pruned.
    """
    size = block_size(study, block)
    features = list(DISTANCE_FEATURES)
    carried = ["n_pos", "n_ts", "n_ok", *[f"n_{c}" for c in carry]]
    h = states.select(
        F.col("pair").alias("_pair"), F.col("spos").alias("n_spos"), F.col("pos").alias("n_pos"), F.col("ts").alias("n_ts"),
        F.col("ahead_ok").alias("n_ok"), *[F.col(f).cast("double").alias(f"_{f}") for f in features],
        *[F.col(c).alias(f"n_{c}") for c in carry],
    ).withColumn(
        "_blk",
        F.explode(
            F.sequence(
                F.floor((F.col("n_spos") + 1) / F.lit(size)).cast("bigint"),
                F.floor((F.col("n_spos") + study.history) / F.lit(size)).cast("bigint"),
            )
        ),
    )
    n = float(len(features))
    std = lambda f: F.col(f"std_{f}").cast("double")
    t = targets.select(
        "pair", "spos", "pos", "ts", *[F.col(f).cast("double").alias(f"_{f}") for f in features],
        *[(1.0 / (std(f) * std(f) * n) if complete else std(f)).alias(f"_w_{f}") for f in features],
    ).withColumn("blk", F.floor(F.col("spos") / F.lit(size)).cast("bigint"))
    fields = {f.name: f for f in [*t.schema.fields, *h.schema.fields]}
    names = ["pair", "blk", "spos", "pos", "ts", "n_spos", *carried]
    schema = T.StructType([*[fields[c] for c in names], T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    history = study.history

    def search(targets: pa.Table, states: pa.Table) -> pa.Table:
        matrix = lambda table, prefix: np.array([table.column(f"{prefix}{f}").to_numpy() for f in features])
        values, wanted, weights = matrix(states, "_"), matrix(targets, "_"), matrix(targets, "_w_")
        positions, spos = states.column("n_spos").to_numpy(), targets.column("spos").to_numpy()
        axis = 0
        if complete and len(spos) and len(positions):  # the feature that tells states apart best
            axis = int(np.argmax(values.var(axis=1) * weights.mean(axis=1)))
        order = np.argsort(values[axis], kind="stable")
        values, positions = np.ascontiguousarray(values[:, order]), positions[order]
        rows, of, ranks, distances = [], [], [], []
        for i, p in enumerate(spos.tolist()):
            found, distance = closest(wanted[:, i], weights[:, i], axis, values[axis], values, positions, p - history, p, k, complete)
            rows.append(order[found])
            of.append(np.full(len(found), i))
            ranks.append(np.arange(1, len(found) + 1, dtype=np.int32))
            distances.append(distance)
        if not rows:
            return pa.Table.from_pylist([], schema=to_arrow_schema(schema))
        at, target = pa.array(np.concatenate(rows)), pa.array(np.concatenate(of))
        columns = [targets.column(c).take(target) for c in names[:5]] + [states.column(c).take(at) for c in names[5:]]
        return pa.table([*columns, pa.array(np.concatenate(distances)), pa.array(np.concatenate(ranks))], names=[*names, "distance", "rank"])

    return spread(t, "pair", "blk").groupBy("pair", "blk").cogroup(spread(h, "_pair", "_blk").groupBy("_pair", "_blk")).applyInArrow(search, schema)


def eligible(neighbours: DataFrame, study: Study) -> DataFrame:
    """Neighbours whose whole outcome ended before the target and ran over gap-free bars."""
    return neighbours.filter((F.col("n_pos") + study.max_horizon < F.col("pos")) & F.col("n_ok"))


def move_names(study: Study) -> list[str]:
    return [f"{d}_{h}" for h in study.horizons for d in ("long", "short")]


def records(states: DataFrame, study: Study, slippage: float = 0.0, commission: float = 0.0) -> DataFrame:
    """Target records without splits: one row per target and horizon."""
    t = targets(states, study).filter("ahead_ok")
    near = eligible(nearest(states, t, study, min(study.neighbours, study.history), carry=move_names(study)), study)
    info = t.select("pair", "spos", "ts", "direction", "regime", "session", *move_names(study), *[f"end_{h}" for h in study.horizons])
    win = lambda d, h: F.avg((net_move(F.col(f"n_{d}_{h}"), slippage, commission) > 0).cast("double"))
    evidence = near.groupBy("pair", "blk", "spos").agg(
        F.count(F.lit(1)).alias("k"),
        F.median("distance").alias("median_distance"),
        F.percentile("distance", F.lit(0.1)).alias("distance_p10"),
        F.percentile("distance", F.lit(0.9)).alias("distance_p90"),
        *[win(d, h).alias(f"agree_{d}_{h}") for h in study.horizons for d in ("long", "short")],
    )
    size = F.lit(block_size(study))
    info = info.withColumn("blk", F.floor(F.col("spos") / size).cast("bigint"))
    joined = evidence.join(info, ["pair", "blk", "spos"])
    side = lambda name, h: F.when(F.col("direction") == "long", F.col(f"{name}long_{h}")).otherwise(F.col(f"{name}short_{h}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(h).cast("bigint").alias("horizon"),
                side("agree_", h).alias("agreement"),
                (net_move(side("", h), slippage, commission) / pip_size("pair")).alias("outcome_pips"),
                F.col(f"end_{h}").alias("target_end"),
            )
            for h in study.horizons
        ]
    )
    return joined.select(
        "pair", "ts", F.year("ts").cast("bigint").alias("year"), "session", "regime", "direction",
        "k", "median_distance", "distance_p10", "distance_p90", F.explode(rows).alias("r"),
    ).select(
        "pair", "ts", "year", "session", "regime", "direction", "r.horizon", "k", "r.agreement",
        "median_distance", "distance_p10", "distance_p90", "r.outcome_pips", "r.target_end",
    )


def two_sided_records(states: DataFrame, study: Study, slippage: float = 0.0, commission: float = 0.0) -> DataFrame:
    """Records of the two-sided study: the direction with the better mean of the nearest k outcomes.

    A target needs its whole neighbour set eligible; a tie or a best mean of at most 0 gives no record.
    """
    top = max(study.k_values)
    t = targets(states, study).filter("ahead_ok")
    near = eligible(nearest(states, t, study, top, carry=move_names(study)), study)
    means = [
        F.avg(F.when(F.col("rank") <= k, net_move(F.col(f"n_{d}_{h}"), slippage, commission))).alias(f"m_{d}_{h}_{k}")
        for h in study.horizons for k in study.k_values for d in ("long", "short")
    ]
    evidence = near.groupBy("pair", "blk", "spos").agg(F.count(F.lit(1)).alias("_n"), *means).filter(F.col("_n") >= top)
    info = t.select(
        "pair", "spos", "ts", "regime", "session", *move_names(study), *[f"end_{h}" for h in study.horizons]
    ).withColumn("blk", F.floor(F.col("spos") / F.lit(block_size(study))).cast("bigint"))
    rows = []
    for h in study.horizons:
        for k in study.k_values:
            long_mean, short_mean = F.col(f"m_long_{h}_{k}"), F.col(f"m_short_{h}_{k}")
            direction = F.when(F.greatest(long_mean, short_mean) <= 0, None).when(long_mean > short_mean, "long").when(
                short_mean > long_mean, "short"
            )
            move = F.when(direction == "long", F.col(f"long_{h}")).otherwise(F.col(f"short_{h}"))
            rows.append(
                F.struct(
                    F.lit(h).cast("bigint").alias("horizon"),
                    F.lit(k).cast("bigint").alias("k"),
                    direction.alias("direction"),
                    F.greatest(long_mean, short_mean).alias("best_mean"),
                    (net_move(move, slippage, commission) / pip_size("pair")).alias("outcome_pips"),
                    F.col(f"end_{h}").alias("target_end"),
                )
            )
    joined = evidence.join(info, ["pair", "blk", "spos"])
    out = joined.select("pair", "ts", "session", "regime", F.explode(F.array(*rows)).alias("r"))
    return out.select(
        "pair", "ts", F.year("ts").cast("bigint").alias("year"), "session", "regime", "r.*"
    ).filter(F.col("direction").isNotNull())
