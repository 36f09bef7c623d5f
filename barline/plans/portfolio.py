"""Flow, allocation, decision and promotion verdicts per instrument."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FlowPolicy:
    samples: int = 200
    confidence: float = 0.55
    edge: float = 0.0
    adverse: float = 1.0
    agreement: float = 0.70


@dataclass(frozen=True)
class PortfolioLimits:
    positions: int = 8
    total: float = 0.02
    asset_class: float = 0.01
    single: float = 0.005


def portfolio_totals(positions: DataFrame) -> DataFrame:
    """Open risk, positions and repeated symbols per asset class."""
    return positions.groupBy("asset_class").agg(
        F.count(F.lit(1)).alias("positions"), F.sum("risk").alias("risk"), F.count_distinct(F.upper("symbol")).alias("symbols")
    ).withColumn("duplicates", F.col("positions") - F.col("symbols"))


def reasons(named: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order; an unknown condition counts as holding."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in named.items()]))


def flow(evidence: DataFrame, policy: FlowPolicy = FlowPolicy()) -> DataFrame:
    """BLOCKED without healthy data and known context, WAIT with any other reason, else READY."""
    low_agreement = F.coalesce(F.col("agreement") < policy.agreement, F.lit(False))
    d = evidence.withColumn(
        "reasons",
        reasons(
            {
                "market_data_unhealthy": ~F.col("data_healthy"),
                "market_context_unknown": ~F.col("context_known"),
                "evidence_floor_not_met": F.col("samples") < policy.samples,
                "confidence_below_floor": F.col("confidence") < policy.confidence,
                "edge_after_costs_not_positive": F.col("edge") <= policy.edge,
                "adverse_risk_above_limit": F.col("adverse") > policy.adverse,
                "expert_agreement_below_floor": low_agreement,
                "instrument_not_research_ready": ~F.col("research_ready"),
            }
        ),
    )
    state = F.when(~F.col("data_healthy") | ~F.col("context_known"), "BLOCKED").when(F.size("reasons") > 0, "WAIT").otherwise("READY")
    return d.withColumn("flow_state", state)


def allocate(flows: DataFrame, positions: DataFrame, limits: PortfolioLimits = PortfolioLimits()) -> DataFrame:
    """Risk budget of each instrument against the open positions.

    Totals of the whole portfolio are scalars, those per class a small table.
    """
    whole = positions.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("risk"), F.lit(0.0)).alias("risk"))
    classes = portfolio_totals(positions).select("asset_class", F.col("risk").alias("class_risk"))
    opened = positions.select(F.upper("symbol").alias("_symbol"), F.lit(True).alias("_open")).distinct()
    d = flows.withColumn("_symbol", F.upper("symbol")).join(classes, "asset_class", "left").join(opened, "_symbol", "left")
    d = d.withColumns(
        {
            "open_positions": whole.select("n").scalar(), "total_risk": whole.select("risk").scalar(),
            "class_risk": F.coalesce("class_risk", F.lit(0.0)), "_open": F.coalesce("_open", F.lit(False)),
        }
    )
    granted = F.least(F.lit(limits.single), limits.total - F.col("total_risk"), limits.asset_class - F.col("class_risk"))
    reason = (
        F.when(F.col("_open"), "position_already_open")
        .when(F.col("open_positions") >= limits.positions, "position_count_limit_reached")
        .when(F.col("total_risk") >= limits.total, "portfolio_risk_limit_reached")
        .when(F.col("class_risk") >= limits.asset_class, "asset_class_risk_limit_reached")
        .when(F.col("flow_state") != "READY", F.concat(F.lit("flow_state_"), F.lower("flow_state")))
        .when(granted <= 0, "no_risk_budget_available")
        .otherwise("bounded_portfolio_risk_budget_granted")
    )
    d = d.withColumn("allocation", reason)
    allowed = F.col("allocation") == "bounded_portfolio_risk_budget_granted"
    return d.withColumn("allowed", allowed).withColumn("budget", F.when(allowed, granted).otherwise(0.0)).drop("_symbol", "_open")


def research_verdict(allocations: DataFrame, missing: Column) -> DataFrame:
    """BLOCKED on missing context features, else the flow state, else READY if a budget was granted."""
    lacking = F.transform(missing, lambda m: F.concat(F.lit("missing_context:"), m))
    verdict = (
        F.when(F.size(missing) > 0, "BLOCKED").when(F.col("flow_state") != "READY", F.col("flow_state"))
        .when(F.col("allowed"), "READY").otherwise("WAIT")
    )
    why = (
        F.when(F.size(missing) > 0, lacking).when(F.col("flow_state") != "READY", F.col("reasons"))
        .when(F.col("allowed"), F.array().cast("array<string>")).otherwise(F.array("allocation"))
    )
    return allocations.withColumn("verdict", verdict).withColumn("verdict_reasons", why)


def decisions(instruments: DataFrame, evidence: DataFrame, samples: int = 200, win_rate: float = 0.55, expectancy: float = 0.0, adverse: float = 1.0) -> DataFrame:
    """BUY or SELL where the evidence passes the limits, WAIT where not, NO_TRADE without evidence."""
    d = instruments.join(evidence, "instrument", "left")
    ok = (F.col("samples") >= samples) & (F.col("win_rate") >= win_rate) & (F.col("expectancy") >= expectancy) & (F.col("adverse") <= adverse)
    action = F.when(F.col("samples").isNull(), "NO_TRADE").when(ok, F.col("direction")).otherwise("WAIT")
    return d.withColumn("action", action).withColumn("confidence", F.coalesce("win_rate", F.lit(0.0)))


PROMOTION_CHECKS = (
    ("credentials_not_configured", "credentials_configured"), ("emergency_stop_not_tested", "emergency_stop_tested"),
    ("daily_loss_not_tested", "daily_loss_tested"), ("stale_spread_not_tested", "stale_spread_tested"),
    ("broker_limits_not_verified", "broker_limits_verified"), ("human_approval_missing", "human_approval_present"),
    ("live_execution_disabled", "live_execution_enabled"),
)


def promotion(evidence: DataFrame) -> DataFrame:
    """Stage reached by each strategy; default deny: a missing flag is a failed one, and live is never reached."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    first = reasons(
        {
            "empirical_confirmation_not_passed": ~flag("empirical_passed"), "robustness_not_passed": ~flag("robustness_passed"),
            "strategy_factory_not_eligible": ~flag("factory_eligible"),
        }
    )
    last = reasons({name: ~flag(c) for name, c in PROMOTION_CHECKS} | {"execution_gateway_disabled": F.lit(True)})
    d = evidence.withColumn("_first", first)
    state = (
        F.when(F.size("_first") > 0, "BLOCKED").when(~flag("paper_passed"), "PAPER_READY").when(~flag("shadow_passed"), "SHADOW_READY").otherwise("BLOCKED")
    )
    why = (
        F.when(F.size("_first") > 0, F.col("_first")).when(~flag("paper_passed"), F.array(F.lit("paper_period_not_passed")))
        .when(~flag("shadow_passed"), F.array(F.lit("shadow_period_not_passed"))).otherwise(last)
    )
    return d.withColumn("state", state).withColumn("reasons", why).drop("_first")
