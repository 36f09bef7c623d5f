"""Per-pair analogue studies: one snapshot, all targets, and the sequential study."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.labels import momentum_direction
from barline.functions.prices import net_move
from barline.functions.statistics import trade_statistics
from barline.operators import evidence as ev
from barline.operators import neighbours as nb
from barline.operators import paths
from barline.operators.features import DISTANCE_FEATURES
from barline.session import Study

OUTCOME = ["pair", "pos", "horizon", "direction"]


def outcome_rows(near: DataFrame, outcomes: DataFrame, extra: list[str]) -> DataFrame:
    """Neighbour rows joined to their forward outcomes in the target's direction (full horizons only)."""
    o = outcomes.filter(F.col("pos") + F.col("horizon") < F.col("bars")).select(
        "pair", F.col("pos").alias("n_pos"), "horizon", "direction", "move", "mfe", "mae"
    )
    return near.select("pair", "n_pos", "direction", *extra).join(o, ["pair", "n_pos", "direction"])


def snapshot(states: DataFrame, outcomes: DataFrame, study: Study, horizon: int, k: int, max_spread: float | None = None) -> DataFrame:
    """The latest state of every pair against all states before it.

    The targets are one row per pair and are joined to the states as a small side; the ranking cuts to k per task first.
    """
    last = states.groupBy("pair").agg(F.max_by(F.struct("pos", "ts", "momentum", *DISTANCE_FEATURES[:2], *DISTANCE_FEATURES[3:]), "pos").alias("t"))
    target = last.select("pair", F.col("t.pos").alias("t_pos"), F.col("t.ts").alias("t_ts"), *[F.col(f"t.{f}").alias(f"t_{f}") for f in DISTANCE_FEATURES])
    history = states.join(target, "pair").filter(F.col("pos") < F.col("t_pos"))
    scaler = history.groupBy("pair").agg(*[F.stddev_samp(f).alias(f"s_{f}") for f in DISTANCE_FEATURES])
    scaler = scaler.withColumns({f"s_{f}": F.when(F.col(f"s_{f}") > 0, F.col(f"s_{f}")).otherwise(1.0) for f in DISTANCE_FEATURES})
    distance = nb.zscore_distance([(F.col(f"t_{f}"), F.col(f), F.col(f"s_{f}")) for f in DISTANCE_FEATURES])
    d = history.join(scaler, "pair").withColumn("distance", distance)
    w = Window.partitionBy("pair").orderBy("distance", "pos")
    near = d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    near = near.withColumn("direction", momentum_direction("t_momentum")).withColumn("n_pos", F.col("pos"))
    counted = near.groupBy("pair").agg(F.count(F.lit(1)).alias("neighbours"), F.max("t_ts").alias("ts"), F.max("direction").alias("direction"))
    usable = near if max_spread is None else near.filter(F.col("spread") <= max_spread)
    rows = outcome_rows(usable, outcomes.filter(F.col("horizon") == horizon), ["rank"])
    low, high = ev.probability_summary("move")[2:4]
    stats = rows.groupBy("pair").agg(
        *trade_statistics("move"), *ev.probability_summary("move")[1:2], low, high, F.median("move").alias("median"), F.avg("mfe").alias("mfe_mean"), F.avg("mae").alias("mae_mean")
    )
    # the path of the outcomes from the nearest neighbour on; k rows a pair
    fall = paths.drawdown(rows, ["pair"], "move", ("rank",), F.lit(0)).select("pair", "max_drawdown")
    return counted.join(stats, "pair", "left").join(fall, "pair", "left").withColumn("max_drawdown", F.coalesce("max_drawdown", F.lit(0.0)))


def neighbour_study(states: DataFrame, outcomes: DataFrame, study: Study) -> DataFrame:
    """Outcomes of all neighbours of all sampled targets, without any check on when those outcomes ended."""
    t = nb.targets(states, study)
    near = nb.nearest(states, t, study, min(study.neighbours, study.history))
    near = near.join(t.select("pair", "spos", "direction"), ["pair", "spos"])
    rows = outcome_rows(near, outcomes, ["spos", "rank", "distance"])
    return rows.groupBy("pair", "horizon").agg(
        *trade_statistics("move"), *ev.probability_summary("move")[1:4], F.avg("mfe").alias("mfe_mean"), F.avg("mae").alias("mae_mean"), F.avg("distance").alias("mean_distance")
    )


def sequential_records(states: DataFrame, study: Study, slippage: float = 0.0, commission: float = 0.0) -> DataFrame:
    """One row per target and full horizon: predicted share, realised move, session, regime.

    A neighbour counts once its longest outcome has ended by the target; gaps do not matter here.
    """
    t = nb.targets(states, study)
    near = nb.nearest(states, t, study, min(study.neighbours, study.history), carry=nb.move_names(study))
    near = near.filter(F.col("n_pos") + study.max_horizon <= F.col("pos"))
    win = lambda d, h: F.avg((net_move(F.col(f"n_{d}_{h}"), slippage, commission) > 0).cast("double"))
    evidence = near.groupBy("pair", "blk", "spos").agg(
        F.count(F.lit(1)).alias("k"), *[win(d, h).alias(f"agree_{d}_{h}") for h in study.horizons for d in ("long", "short")]
    )
    info = t.select("pair", "spos", "pos", "bars", "ts", "direction", "regime", "session", *nb.move_names(study)).withColumn(
        "blk", F.floor(F.col("spos") / F.lit(nb.block_size(study))).cast("bigint")
    )
    side = lambda name, h: F.when(F.col("direction") == "long", F.col(f"{name}long_{h}")).otherwise(F.col(f"{name}short_{h}"))
    rows = F.array(
        *[
            F.struct(F.lit(h).cast("bigint").alias("horizon"), side("agree_", h).alias("predicted"), net_move(side("", h), slippage, commission).alias("value"))
            for h in study.horizons
        ]
    )
    d = evidence.join(info, ["pair", "blk", "spos"]).withColumn("r", F.explode(rows)).filter(F.col("pos") + F.col("r.horizon") < F.col("bars"))
    return d.select("pair", "ts", "session", "regime", F.year("ts").cast("bigint").alias("year"), "direction", "k", "r.horizon", "r.predicted", "r.value")


def sequential_report(records: DataFrame) -> DataFrame:
    """Out-of-sample statistics, Brier score and average analogue count per pair and horizon."""
    y = (F.col("value") > 0).cast("double")
    return records.groupBy("pair", "horizon").agg(
        *trade_statistics("value"), F.avg((F.col("predicted") - y) * (F.col("predicted") - y)).alias("brier"),
        F.avg("predicted").alias("predicted_rate"), F.avg(y).alias("realised_rate"), F.avg("k").alias("mean_analogues"),
    )


def walk_forward(records: DataFrame, folds: DataFrame) -> DataFrame:
    """Statistics of the study's records in the test window of each expanding fold of their pair; the fold table is a row per pair and fold."""
    d = records.join(folds, "pair").filter((F.col("ts") > F.col("test_start")) & (F.col("ts") <= F.col("test_end")))
    stats = d.groupBy("pair", "horizon", "train_end").agg(*trade_statistics("value"))
    return stats.join(folds, ["pair", "train_end"])
