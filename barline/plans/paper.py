"""Hypothetical fills, session evaluation, campaign verdicts and hash-chained journals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.statistics import ratio
from barline.operators.ordering import in_blocks, with_positions
from barline.operators.paths import drawdown
from barline.plans.portfolio import reasons

MONEY = "decimal(18,8)"
NO_HASH = "0" * 64


def fills(signals: DataFrame) -> DataFrame:
    """BUY at the ask plus slippage, SELL at the bid minus it; unauthorised signals are rejected."""
    ask, bid, slip = (F.col(c).cast(MONEY) for c in ("ask", "bid", "slippage"))
    go = F.col("authorized") & F.col("action").isin("BUY", "SELL")
    entry = F.when(go, F.when(F.col("action") == "BUY", ask + slip).otherwise(bid - slip))
    return signals.withColumns({"event": F.when(go, "FILLED").otherwise("REJECTED"), "entry_price": entry.cast(MONEY), "spread": (ask - bid).cast(MONEY)})


def closes(filled: DataFrame, quotes: DataFrame) -> DataFrame:
    """Close filled orders at the other side of their closing quote; orders without one stay open."""
    q = quotes.select("order_id", F.col("bid").cast(MONEY).alias("x_bid"), F.col("ask").cast(MONEY).alias("x_ask"), F.col("ts").alias("closed_at"))
    d = filled.join(q, "order_id", "left")
    shut = (F.col("event") == "FILLED") & F.col("x_bid").isNotNull()
    slip, buy = F.col("slippage").cast(MONEY), F.col("action") == "BUY"
    exit_price = F.when(shut, F.when(buy, F.col("x_bid") - slip).otherwise(F.col("x_ask") + slip)).cast(MONEY)
    d = d.withColumn("exit_price", exit_price)
    move = (F.col("exit_price") - F.col("entry_price")).cast(MONEY)
    pnl = (move * F.col("quantity").cast(MONEY)) * F.when(buy, 1).otherwise(-1)
    return d.withColumn("pnl", pnl.cast("decimal(38,16)")).withColumn("event", F.when(shut, "CLOSED").otherwise(F.col("event"))).drop("x_bid", "x_ask")


ORDERS = 65_536  # ids in one block of the order check


def session_evaluation(orders: DataFrame, max_loss: float, min_closed: int, keys: Sequence[str] = ("session_id",), sequence: str = "order_id") -> DataFrame:
    """Totals, profit factor, drawdown, input checks and failure reasons per session.

    Closed orders need an id of their own, a time no earlier than that of the closed order before them in ``sequence``, and a profit or loss.
    """
    keys = list(keys)
    closed = orders.filter(F.col("event") == "CLOSED")
    p = F.col("pnl")
    gain, loss = F.sum(F.when(p > 0, p)), -F.sum(F.when(p < 0, p))
    stats = closed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("closed_trades"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.sum(p).alias("total_pnl"),
        ratio(F.coalesce(gain.cast("double"), F.lit(0.0)), F.coalesce(loss.cast("double"), F.lit(0.0))).alias("profit_factor"),
        (F.count_distinct("order_id") == F.count(F.lit(1))).alias("unique_ids"), (F.count(p) == F.count(F.lit(1))).alias("pnl_present"),
    )
    placed = with_positions(closed.select(*keys, sequence, "ts"), keys, [sequence, "ts"], F.floor(F.col(sequence) / ORDERS))
    lagged = in_blocks(placed, keys, "pos", 1, 0, lambda x, window: x.withColumn("_late", F.lag("ts").over(window()) > F.col("ts")))
    in_order = lagged.groupBy(*keys).agg((~F.bool_or(F.coalesce("_late", F.lit(False)))).alias("chronological"))
    sessions = orders.select(*keys).distinct()
    d = sessions.join(stats, keys, "left").join(in_order, keys, "left").join(drawdown(closed, keys, "pnl", ("ts", "order_id")).select(*keys, "max_drawdown"), keys, "left")
    n = F.coalesce("closed_trades", F.lit(0))
    total = F.coalesce(F.col("total_pnl").cast("double"), F.lit(0.0))
    checks = {c: F.coalesce(c, F.lit(True)) for c in ("unique_ids", "chronological", "pnl_present")}
    d = d.withColumns(checks).withColumns(
        {
            "closed_trades": n, "wins": F.coalesce("wins", F.lit(0)), "losses": F.coalesce("losses", F.lit(0)), "total_pnl": total,
            "expectancy": F.when(n > 0, total / n).otherwise(0.0), "max_drawdown": F.coalesce("max_drawdown", F.lit(0.0)),
            "failures": reasons({
                "duplicate_closed_order_id": ~F.col("unique_ids"), "closed_orders_not_chronological": ~F.col("chronological"), "closed_order_without_pnl": ~F.col("pnl_present"),
                "minimum_closed_trades_not_met": n < min_closed, "maximum_session_loss_breached": total <= max_loss, "no_closed_trades": n == 0,
            }),
        }
    )
    return d.withColumn("passed", F.size("failures") == 0)


def campaign(evaluations: DataFrame, observations: DataFrame, spec: dict[str, float], complete: Column, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """COMPLETE without a reason; FAILED on a performance reason; INCOMPLETE if only evidence is short."""
    d = observations.join(evaluations, list(keys), "left")
    there = F.col("closed_trades").isNotNull()
    named = {
        "campaign_window_not_complete": ~complete,
        "minimum_accepted_observations_not_met": F.col("accepted") < int(spec["accepted"]),
        "paper_evaluation_missing": ~there,
        "minimum_closed_trades_not_met": there & (F.col("closed_trades") < int(spec["closed"])),
        "maximum_session_loss_breached": there & F.array_contains("failures", "maximum_session_loss_breached"),
        "no_closed_trades": there & F.array_contains("failures", "no_closed_trades"),
        "paper_expectancy_not_positive": there & (F.col("expectancy") <= float(spec["expectancy"])),
        "paper_profit_factor_not_above_threshold": there & (F.col("profit_factor").isNull() | (F.col("profit_factor") <= float(spec["profit_factor"]))),
    }
    d = d.withColumn("reasons", F.array_distinct(reasons({k: F.coalesce(v, F.lit(False)) for k, v in named.items()})))
    has = lambda names: F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in names]))
    state = (
        F.when(F.size("reasons") == 0, "COMPLETE")
        .when(has(("paper_expectancy_not_positive", "paper_profit_factor_not_above_threshold", "maximum_session_loss_breached")), "FAILED")
        .when(has(("campaign_window_not_complete", "minimum_accepted_observations_not_met", "minimum_closed_trades_not_met", "paper_evaluation_missing")), "INCOMPLETE")
        .otherwise("FAILED")
    )
    return d.withColumn("state", state)


def payload() -> Column:
    """Canonical JSON of a journal entry without its own hash."""
    return F.to_json(F.struct("entry", "kind", "previous_hash", "sequence", "session_id", "ts"))


JOURNAL = T.StructType(
    [
        T.StructField("session_id", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("entry", T.LongType()), T.StructField("kind", T.StringType()),
        T.StructField("sequence", T.LongType()), T.StructField("previous_hash", T.StringType()), T.StructField("record_hash", T.StringType()),
    ]
)


def entry_hash(entry: int, kind: str, previous: str, sequence: int, session: int, ts: int) -> str:
    text = f'{{"entry":{entry},"kind":"{kind}","previous_hash":"{previous}","sequence":{sequence},"session_id":{session},"ts":{ts}}}'
    return hashlib.sha256(text.encode()).hexdigest()


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    session, sequence, head = None, 0, NO_HASH
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            if r.session_id != session:
                session, sequence, head = r.session_id, 0, NO_HASH
            sequence, previous = sequence + 1, head
            head = entry_hash(r.entry, r.kind, previous, sequence, r.session_id, r.ts)
            out.append((r.session_id, r.ts, r.entry, r.kind, sequence, previous, head))
        yield pd.DataFrame(out, columns=[f.name for f in JOURNAL])


def journal(entries: DataFrame) -> DataFrame:
    """Chain entries (session_id, ts, entry, kind) per session in time order.

    Each hash needs the one before it, so a session is one ordered pass; rows stream through sorted
    partitions and only the head of the current session is held.
    """
    d = entries.select("session_id", "ts", "entry", "kind").repartition("session_id").sortWithinPartitions("session_id", "ts", "entry")
    return d.mapInPandas(_chain, JOURNAL)


def verified(records: DataFrame) -> DataFrame:
    """Checks per session: sequence, time order, links, recomputed hashes, at most one final entry.

    Every entry is checked on its own against its predecessor, block by block.
    """
    d = records.withColumn("pos", F.col("sequence") - 1)

    def compute(x: DataFrame, window) -> DataFrame:  # noqa: ANN001
        w = window()
        return x.withColumns({"_head": F.lag("record_hash").over(w), "_seq": F.lag("sequence").over(w), "_ts": F.lag("ts").over(w)})

    d = in_blocks(d, ["session_id"], "pos", 1, 0, compute)
    first = F.col("_seq").isNull()
    return d.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.bool_and(F.when(first, F.col("sequence") == 1).otherwise(F.col("sequence") == F.col("_seq") + 1)).alias("contiguous"),
        F.bool_and(first | (F.col("ts") >= F.col("_ts"))).alias("chronological"),
        F.bool_and(F.col("previous_hash") == F.coalesce("_head", F.lit(NO_HASH))).alias("linked"),
        F.bool_and(F.sha2(payload(), 256) == F.col("record_hash")).alias("hashes_ok"),
        F.count_if(F.col("kind") == "FINALIZED").alias("finalized"), F.max_by("record_hash", "sequence").alias("head_hash"),
    ).withColumn("ok", F.col("contiguous") & F.col("chronological") & F.col("linked") & F.col("hashes_ok") & (F.col("finalized") <= 1))


def export(records: DataFrame, checks: DataFrame, per_part: int = 1000) -> DataFrame:
    """Verified sessions as JSON documents of up to ``per_part`` records each, with head hash and part number.

    A short session is one document; a long one is several, so no row holds an unbounded session.
    """
    ok = checks.filter("ok").select("session_id", "head_hash", "records")
    d = records.join(ok, "session_id").withColumn("part", F.floor((F.col("sequence") - 1) / per_part).cast("bigint"))
    row = F.struct("sequence", "entry", "kind", "previous_hash", "record_hash", "ts")
    g = d.groupBy("session_id", "head_hash", "part").agg(F.array_sort(F.collect_list(row)).alias("records"))
    return g.select("session_id", "part", "head_hash", F.size("records").alias("n"), F.to_json(F.struct("head_hash", "part", "records", "session_id")).alias("document"))
