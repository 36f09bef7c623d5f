"""Research jobs over target records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.catalog.evidence import ATLAS, atlas_cells, ATLAS_HIGH, ATLAS_LOW, ATLAS_MINIMUM, ATLAS_REPS, ATLAS_SEED, ATLAS_STRONG, EVAL, PF, REC, TRADE, TWO, WIN, audit_cells, drawdown_sql, rolled_up, wilson_sql
from barline.catalog.fragments import S
from barline.catalog.inference import draws_sql, hac_sql
from barline.catalog.registry import Tables, fragment, query
from barline.operators import evidence as ev
from barline.operators import paths
from barline.plans import candidates as cd
from barline.session import written

SCREEN = cd.Screen(samples=10, alpha=0.05, profit_factor=1.10, reps=1000, low=25)
TWO_SCREEN = cd.Screen(samples=30, alpha=0.05, profit_factor=1.10, reps=1000, low=25)
CONFIRM = cd.Confirmation(samples=20, reps=2000, low=50, simulations=5000, pair_samples=5, positive_pairs=2)
CERTIFY = cd.Certification(folds=12, trades=5, series=2, positive_series=1, series_trades=2, reps=2000, low=50)

ID7 = "concat_ws('|', horizon, regime, session, pairset, direction, agreement_min, coalesce(CAST(distance_max AS VARCHAR), 'none'))"
ID6 = "concat_ws('|', horizon, regime, session, pairset, agreement_min, coalesce(CAST(distance_max AS VARCHAR), 'none'))"


def sampled(source: str, keys: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts, pair) - 1 AS rn FROM {source})"


def boot(source: str, keys: str, reps: int, seed: int, low: int, high: int | None = None) -> str:
    sizes = f"(SELECT {keys}, count(*) AS n FROM {source} GROUP BY {keys} HAVING count(*) >= 2)"
    means = f"SELECT {keys}, rep, avg(v) AS mean FROM ({draws_sql(sizes, keys, reps, seed, 'n', 'n')}) JOIN {sampled(source, keys)} USING ({keys}, rn) GROUP BY {keys}, rep"
    upper = "" if high is None else f"max(mean) FILTER (r = {high}) AS upper, "
    return f"""SELECT {keys}, max(mean) FILTER (r = {low}) AS lower, {upper}avg(CAST(mean > 0 AS INT)) AS probability_positive FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY mean, rep) - 1 AS r FROM ({means})) GROUP BY {keys}"""


def block_boot(source: str, keys: str, reps: int, seed: int, low: int) -> str:
    sizes = f"(SELECT *, CAST(ceil(n / 5) AS BIGINT) AS blocks, CASE WHEN n % 5 = 0 THEN n // 5 ELSE CAST(ceil(n / (n % 5)) AS BIGINT) END AS steps FROM (SELECT {keys}, count(*) AS n FROM {source} GROUP BY {keys} HAVING count(*) >= 2))"
    blocks = f"(SELECT {keys}, rn // 5 AS rn, count(*) AS len, list(v ORDER BY rn) AS vs FROM {sampled(source, keys)} GROUP BY {keys}, rn // 5)"
    means = f"""SELECT {keys}, rep, sum(list_sum(vs[1:least(len, n - before)])) / max(n) AS mean FROM (SELECT *, coalesce(sum(len) OVER (PARTITION BY {keys}, rep ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
 FROM ({draws_sql(sizes, keys, reps, seed, 'steps', 'blocks')}) JOIN {blocks} USING ({keys}, rn) JOIN {sizes} USING ({keys})) WHERE before < n GROUP BY {keys}, rep"""
    return f"""SELECT {keys}, max(mean) FILTER (r = {low}) AS block_lower FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY mean, rep) - 1 AS r FROM ({means})) GROUP BY {keys}"""


def ruin(source: str, keys: str, reps: int, seed: int, cost: float) -> str:
    sizes = f"(SELECT {keys}, count(*) AS n FROM {source} GROUP BY {keys})"
    return f"""SELECT {keys}, avg(CAST(low <= 0 AS INT)) AS ruin_probability FROM (SELECT {keys}, rep, min(capital) AS low FROM (SELECT *, 20 + sum(v - {cost}::DOUBLE) OVER (PARTITION BY {keys}, rep ORDER BY step ROWS UNBOUNDED PRECEDING) AS capital
 FROM ({draws_sql(sizes, keys, reps, seed, 'n', 'n')}) JOIN {sampled(source, keys)} USING ({keys}, rn)) GROUP BY {keys}, rep) GROUP BY {keys}"""


def holm(source: str, keys: str, family: str = "") -> str:
    part = f"PARTITION BY {family}" if family else ""
    return f"""SELECT *, max(least(1, (m - r + 1) * p_value)) OVER ({part} ORDER BY r) AS p_holm FROM (SELECT *, count(*) OVER ({part}) AS m, row_number() OVER ({part} ORDER BY p_value, {keys}) AS r FROM ({source}))"""


def diversity(source: str, keys: str, least: int, null_counts: bool = False) -> str:
    good = "(profit_factor IS NULL OR profit_factor > 1)" if null_counts else "profit_factor > 1"
    return f"SELECT {keys}, count(*) FILTER (n >= {least}) AS eligible_pairs, count(*) FILTER (n >= {least} AND expectancy > 0 AND {good}) AS positive_pairs, max(n) / sum(n) AS largest_share FROM (SELECT {keys}, pair, {TRADE} FROM {source} GROUP BY {keys}, pair) GROUP BY {keys}"


# ---- discovery

fragment("x_family", f"SELECT *, {ID7} AS cand FROM x_grid WHERE pairset = 'all' AND n >= {SCREEN.samples}")
fragment("x_family_hits", f"SELECT * FROM (SELECT *, {ID7} AS cand FROM x_grid_hits WHERE global_split = 'discovery' AND pairset = 'all') WHERE cand IN (SELECT cand FROM x_family)")
fragment("x_family_holm", holm(f"SELECT f.*, h.p_value FROM x_family f JOIN ({hac_sql('x_family_hits', 'cand', 'pair, ts')}) h USING (cand)", "cand"))
fragment("x_family_strong", f"SELECT * FROM x_family_hits WHERE cand IN (SELECT cand FROM x_family_holm WHERE profit_factor >= {SCREEN.profit_factor} AND p_value <= {SCREEN.alpha})")
fragment("x_discovery", f"""
SELECT f.*, b.lower, CASE WHEN profit_factor IS NULL OR profit_factor < {SCREEN.profit_factor} THEN 'failed profit factor' WHEN p_value > {SCREEN.alpha} THEN 'failed raw discovery HAC p-value prefilter'
  WHEN p_holm > {SCREEN.alpha} THEN 'failed discovery-family Holm-adjusted HAC p-value' WHEN NOT coalesce(lower > 0, false) THEN 'failed discovery bootstrap lower-tail admission' ELSE 'selected' END AS outcome
FROM x_family_holm f LEFT JOIN ({boot('x_family_strong', 'cand', SCREEN.reps, SCREEN.seed, SCREEN.low)}) b USING (cand)""")
FOUND = "cand n:i expectancy:d profit_factor:d p_value:d p_holm:d lower:d outcome"


def found(t: Tables) -> DataFrame:
    return t._keep("discovery", lambda: cd.discovery(t.records(), SCREEN))


@query("q9_fresh_discovery", FOUND, "SELECT * FROM x_discovery")
def q9(t: Tables) -> DataFrame:
    return found(t)


@query(
    "k1_ranked_candidates", FOUND,
    "SELECT * FROM x_discovery WHERE outcome <> 'failed profit factor' ORDER BY round(lower, 6) DESC NULLS LAST, round(profit_factor, 6) DESC NULLS LAST, round(expectancy, 6) DESC, n DESC, cand LIMIT 25",
)
def k1(t: Tables) -> DataFrame:
    return ev.top(found(t).filter(F.col("outcome") != "failed profit factor"), cd.discovery_order(), SCREEN.keep)


TS = TWO_SCREEN
fragment("x_two_d", f"SELECT * FROM {TWO} WHERE global_split = 'discovery'")
fragment("x_two_family", f"""
SELECT s.*, p.positive_pairs >= 2 AND p.largest_share <= 0.8 AS pair_robust FROM ({holm(f"SELECT s.*, h.p_value FROM (SELECT horizon, k, {TRADE} FROM x_two_d GROUP BY 1, 2 HAVING count(*) >= {TS.samples}) s JOIN ({hac_sql('x_two_d', 'horizon, k')}) h USING (horizon, k)", "horizon, k")}) s
JOIN ({diversity('x_two_d', 'horizon, k', 5, True)}) p USING (horizon, k)""")
fragment("x_two_strong", f"SELECT d.* FROM x_two_d d JOIN x_two_family f USING (horizon, k) WHERE f.pair_robust AND f.profit_factor >= {TS.profit_factor} AND f.p_value <= {TS.alpha}")


@query(
    "q11_two_sided_discovery", "horizon:i k:i n:i expectancy:d profit_factor:d p_value:d p_holm:d pair_robust:b lower:d block_lower:d outcome",
    f"""SELECT f.*, a.lower, b.block_lower, CASE WHEN NOT pair_robust THEN 'failed discovery pair-diversity/concentration gate' WHEN profit_factor IS NULL OR profit_factor < {TS.profit_factor} THEN 'failed discovery profit-factor gate'
  WHEN p_holm > {TS.alpha} THEN 'failed discovery-family Holm-adjusted HAC p-value' WHEN NOT coalesce(lower > 0 AND block_lower > 0, false) THEN 'failed ordinary/block bootstrap lower-tail gate' ELSE 'selected' END AS outcome
FROM x_two_family f LEFT JOIN ({boot('x_two_strong', 'horizon, k', TS.reps, TS.seed, TS.low)}) a USING (horizon, k) LEFT JOIN ({block_boot('x_two_strong', 'horizon, k', TS.reps, TS.seed + 1, TS.low)}) b USING (horizon, k)""",
)
def q11(t: Tables) -> DataFrame:
    return cd.two_sided_discovery(t.two_sided(), TWO_SCREEN, CONFIRM)


# ---- enriched search, capacity, robustness

fragment("x_search_cells", f"SELECT horizon, regime, session, pairset, agreement_min, distance_max, {TRADE}, {ID6} AS cand FROM x_grid_hits WHERE split = 'discovery' GROUP BY horizon, regime, session, pairset, agreement_min, distance_max HAVING count(*) >= 10")
fragment("x_search", "SELECT * FROM x_search_cells ORDER BY round(expectancy, 6) DESC, round(profit_factor, 6) DESC NULLS LAST, cand LIMIT 10")
fragment("x_search_hits", f"SELECT * FROM (SELECT *, {ID6} AS cand FROM x_grid_hits WHERE split = 'confirmation') WHERE cand IN (SELECT cand FROM x_search)")


def search(t: Tables) -> DataFrame:
    return t._keep("search", lambda: cd.enriched_search(t.records(), 10))


def search_hits(t: Tables) -> DataFrame:
    return cd.hits_of(t.records(), search(t), "confirmation")


@query(
    "q4_enriched_search", "cand n:i expectancy:d profit_factor:d win_rate:d c_n:i c_expectancy:d c_median:d",
    f"SELECT s.*, c.n AS c_n, c.expectancy AS c_expectancy, c.median AS c_median FROM x_search s LEFT JOIN (SELECT cand, {EVAL} FROM x_search_hits GROUP BY 1) c USING (cand)",
)
def q4(t: Tables) -> DataFrame:
    c = ev.evaluation(search_hits(t), ["cand"], "outcome_pips")
    return search(t).join(c.select("cand", F.col("n").alias("c_n"), F.col("expectancy").alias("c_expectancy"), F.col("median").alias("c_median")), "cand", "left")


@query("q5_holdout_capacity", "cand holdout_n:i eligible:b", "SELECT cand, count(h.v) AS holdout_n, count(h.v) >= 10 AS eligible FROM x_search s LEFT JOIN x_search_hits h USING (cand) GROUP BY 1")
def q5(t: Tables) -> DataFrame:
    return cd.capacity(t.records(), search(t), 10)


def survives_sql(cost: float) -> str:
    v = f"(v - {cost}::DOUBLE)"
    return f"(avg({v}) > 0 AND coalesce(sum({v}) FILTER ({v} > 0) / nullif(-sum({v}) FILTER ({v} < 0), 0) > 1, false))"


@query(
    "q6_conditional_robustness", "cand n:i expectancy:d profit_factor:d max_drawdown:d positive_pairs:i promotion_eligible:b failed",
    f"""SELECT *, failed = '' AS promotion_eligible FROM (SELECT b.*, d.max_drawdown, p.positive_pairs, concat_ws(',', CASE WHEN NOT coalesce(profit_factor > 1, false) THEN 'confirmation_pf_gt_1' END, CASE WHEN NOT expectancy > 0 THEN 'confirmation_expectancy_positive' END,
 CASE WHEN n < 20 THEN 'confirmation_sample_min_100' END, CASE WHEN NOT s02 THEN 'stress_0_2_pips_positive' END, CASE WHEN NOT s05 THEN 'stress_0_5_pips_positive' END, CASE WHEN NOT s10 THEN 'stress_1_0_pips_positive' END,
 CASE WHEN positive_pairs < 2 THEN 'positive_pair_count_min_2' END) AS failed
FROM (SELECT cand, {TRADE}, {survives_sql(0.2)} AS s02, {survives_sql(0.5)} AS s05, {survives_sql(1.0)} AS s10 FROM x_search_hits GROUP BY 1) b JOIN ({drawdown_sql('x_search_hits', 'cand')}) d USING (cand) JOIN ({diversity('x_search_hits', 'cand', 1)}) p USING (cand))""",
)
def q6(t: Tables) -> DataFrame:
    return cd.conditional_robustness(search_hits(t), 20).withColumn("failed", F.array_join("failed", ","))


ID_S = "concat_ws('|', pair, horizon, regime, session, agreement_min, coalesce(CAST(distance_max AS VARCHAR), 'none'))"
_SGRID = "(SELECT unnest([0.5, 0.6, 0.7])::DOUBLE AS agreement_min), (SELECT unnest([NULL, 0.5, 1.0, 1.5, 2.0])::DOUBLE AS distance_max)"
fragment("x_surv_hits", f"SELECT *, {ID_S} AS cand FROM {REC}, {_SGRID} WHERE agreement >= agreement_min AND (distance_max IS NULL OR median_distance <= distance_max)")
fragment("x_surv", f"""
SELECT s.*, h.worst_half, c.holdout_n, y.positive_years FROM (SELECT cand, {TRADE} FROM x_surv_hits WHERE split = 'discovery' GROUP BY 1 HAVING count(*) >= 8 AND avg(v) > 0 AND {PF} > 1) s
JOIN (SELECT cand, min(e) AS worst_half FROM (SELECT cand, rn < n // 2 AS h, avg(v) AS e, {PF} AS pf, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY ts, pair) - 1 AS rn, count(*) OVER (PARTITION BY cand) AS n FROM x_surv_hits WHERE split = 'discovery') GROUP BY 1, 2)
  GROUP BY 1 HAVING bool_and(n >= 3 AND e > 0 AND coalesce(pf > 1, false)) AND count(*) = 2) h USING (cand)
JOIN (SELECT cand, count(*) AS holdout_n FROM x_surv_hits WHERE split = 'confirmation' GROUP BY 1 HAVING count(*) >= 3) c USING (cand)
JOIN (SELECT cand, count(*) FILTER (n >= 3 AND e > 0) AS positive_years FROM (SELECT cand, year, count(*) AS n, avg(v) AS e FROM x_surv_hits WHERE split = 'discovery' GROUP BY 1, 2) GROUP BY 1) y USING (cand)
WHERE positive_years >= 1 ORDER BY round(worst_half, 6) DESC, round(expectancy, 6) DESC, round(profit_factor, 6) DESC NULLS LAST, cand LIMIT 20""")


def survivors(t: Tables) -> DataFrame:
    return t._keep("survivors", lambda: cd.survival_search(t.records(), 8, 3, 3, 1, 3))


@query("q7_survival_search", "cand n:i expectancy:d profit_factor:d worst_half:d holdout_n:i positive_years:i", "SELECT * FROM x_surv")
def q7(t: Tables) -> DataFrame:
    return survivors(t)


@query(
    "q7_survival_promotion", "cand n:i expectancy:d profit_factor:d state failed",
    f"""SELECT *, CASE WHEN failed = '' THEN 'PASS' ELSE 'FAIL' END AS state FROM (SELECT b.*, concat_ws(',', CASE WHEN n < 5 THEN 'confirmation_sample_min_100' END, CASE WHEN NOT expectancy > 0 THEN 'confirmation_expectancy_positive' END,
 CASE WHEN NOT coalesce(profit_factor > 1, false) THEN 'confirmation_pf_gt_1' END, CASE WHEN NOT s THEN 'stress_positive' END, CASE WHEN y < 1 THEN 'confirmation_temporally_stable' END) AS failed
FROM (SELECT cand, {TRADE}, {survives_sql(0.2)} AND {survives_sql(0.5)} AS s FROM x_surv_hits WHERE split = 'confirmation' AND cand IN (SELECT cand FROM x_surv) GROUP BY 1) b
JOIN (SELECT cand, count(*) FILTER (n >= 2 AND e > 0) AS y FROM (SELECT cand, year, count(*) AS n, avg(v) AS e FROM x_surv_hits WHERE split = 'confirmation' GROUP BY 1, 2) GROUP BY 1) USING (cand))""",
)
def q7b(t: Tables) -> DataFrame:
    return cd.survival_promotion(t.records(), survivors(t), 5, 1, 2).withColumn("failed", F.array_join("failed", ","))


# ---- confirmation

CONF = "cand n:i expectancy:d profit_factor:d max_drawdown:d lower:d block_lower:d ruin_probability:d positive_pairs:i largest_share:d state failed"


def confirm_sql(hits: str, r: cd.Confirmation) -> str:
    stress = " AND ".join(survives_sql(c) for c in r.stress)
    gates = {
        "sample": f"n >= {r.samples}", "expectancy_positive": "expectancy > 0", "profit_factor_gt_1": "profit_factor > 1", "chronological_fold_stability": "fp", "stress_resilient": "st",
        "uncertainty_supportive": "least(lower, block_lower) > 0 AND probability_positive >= 0.95 AND ruin_probability < 0.05",
        "positive_pairs": f"positive_pairs >= {r.positive_pairs}", "pair_concentration": f"largest_share <= {r.largest_share}",
    }
    failed = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{g}' END" for g, c in gates.items())
    return f"""SELECT *, CASE WHEN n < {r.samples} THEN 'INCOMPLETE' WHEN failed = '' THEN 'PASS' ELSE 'FAIL' END AS state FROM (SELECT *, concat_ws(',', {failed}) AS failed
FROM (SELECT cand, {TRADE}, {stress} AS st FROM {hits} GROUP BY 1) JOIN ({drawdown_sql(hits, 'cand')}) USING (cand)
LEFT JOIN (SELECT cand, bool_and(e > 0) AS fp FROM (SELECT cand, least(rn // (n // {r.folds}), {r.folds - 1}) AS fold, avg(v) AS e FROM (SELECT *, count(*) OVER (PARTITION BY cand) AS n FROM {sampled(hits, 'cand')}) WHERE n >= {r.folds} GROUP BY 1, 2) GROUP BY 1) USING (cand)
JOIN ({diversity(hits, 'cand', r.pair_samples)}) USING (cand) LEFT JOIN ({boot(hits, 'cand', r.reps, r.seed, r.low)}) USING (cand) LEFT JOIN ({block_boot(hits, 'cand', r.reps, r.seed + 1, r.low)}) USING (cand)
LEFT JOIN ({ruin(hits, 'cand', r.simulations, r.seed + 2, r.ruin_cost)}) USING (cand))"""


FROZEN = cd.Confirmation(samples=20, stress=(0.0, 0.2, 0.5, 1.0), reps=2000, low=50, simulations=5000, pair_samples=1, positive_pairs=2, ruin_cost=0.2, largest_share=1.0)


@query("q8_frozen_evaluation", CONF, confirm_sql("x_search_hits", FROZEN))
def q8(t: Tables) -> DataFrame:
    return cd.confirmation(search_hits(t), FROZEN).withColumn("failed", F.array_join("failed", ","))


@query("q8_frozen_drift", "cand n:i unchanged:b", "SELECT cand, n, n % 2 = 0 AS unchanged FROM x_search")
def q8b(t: Tables) -> DataFrame:
    again = ev.evaluation(cd.hits_of(t.records(), search(t), "discovery"), ["cand"], "outcome_pips")
    stored = search(t).withColumn("expectancy", F.col("expectancy") + F.when(F.col("n") % 2 == 0, 0.0).otherwise(0.5))
    return cd.frozen_drift(again, stored)


fragment("x_first", "SELECT * FROM x_discovery WHERE outcome <> 'failed profit factor' ORDER BY round(lower, 6) DESC NULLS LAST, round(profit_factor, 6) DESC NULLS LAST, round(expectancy, 6) DESC, n DESC, cand LIMIT 25")
fragment("x_first_hits", f"SELECT * FROM (SELECT *, {ID7} AS cand FROM x_grid_hits WHERE global_split = 'confirmation' AND pairset = 'all') WHERE cand IN (SELECT cand FROM x_first)")


def first_hits(t: Tables) -> DataFrame:
    best = ev.top(found(t).filter(F.col("outcome") != "failed profit factor"), cd.discovery_order(), 25)
    r = t.records().filter(F.col("global_split") == "confirmation").withColumn("pairset", F.lit("all"))
    return ev.matching(r, best.select("cand", *cd.POINT), cd.CELL)


FRESH = cd.Confirmation(samples=5, reps=2000, low=50, simulations=5000, pair_samples=2, positive_pairs=2)


@query("q10_fresh_confirmation", CONF, confirm_sql("x_first_hits", FRESH))
def q10(t: Tables) -> DataFrame:
    return cd.confirmation(first_hits(t), FRESH).withColumn("failed", F.array_join("failed", ","))


fragment("x_two_hits", f"SELECT *, horizon || '|' || k AS cand FROM {TWO} WHERE global_split = 'confirmation'")


def two_hits(t: Tables) -> DataFrame:
    c = t.two_sided().filter(F.col("global_split") == "confirmation")
    return c.withColumn("cand", F.concat_ws("|", "horizon", "k"))


@query("q12_two_sided_confirmation", CONF, confirm_sql("x_two_hits", CONFIRM))
def q12(t: Tables) -> DataFrame:
    return cd.confirmation(two_hits(t), CONFIRM).withColumn("failed", F.array_join("failed", ","))


# ---- certification

CC = CERTIFY
CELLS = "cand fold:i model n:i expectancy:d profit_factor:d net_profit:d max_drawdown:d recovery_ratio:d p_value:d p_holm:d lower:d block_lower:d eligible_pairs:i positive_pairs:i largest_share:d qualifies:b failed"


def bounds_sql(timeline: str) -> str:
    return f"""SELECT fold, start, lead(start) OVER (ORDER BY fold) AS stop FROM (SELECT f AS fold, ts AS start FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS n
 FROM (SELECT DISTINCT ts FROM {timeline})) JOIN (SELECT unnest(generate_series(0, {CC.folds - 1})) AS f) ON idx = n * f // {CC.folds})"""


def kept_sql(hits: str, bounds: str) -> str:
    end = f"ts + to_seconds(horizon * {S.interval_s})"
    return f"SELECT h.*, fold FROM {hits} h JOIN {bounds} ON ts >= start + to_seconds(horizon * {S.interval_s}) AND (stop IS NULL OR (ts < stop AND {end} < stop))"


_MODELS = "(VALUES ('base', 0.4::DOUBLE), ('realistic', 0.8::DOUBLE), ('stress', 1.5::DOUBLE)) m(model, cost)"


def cells_sql(runs: str) -> str:
    k = "cand, fold, model"
    gates = {
        "trades": f"n >= {CC.trades}", "series": f"eligible_pairs >= {CC.series}", "positive_series": f"positive_pairs >= {CC.positive_series}", "concentration": f"largest_share <= {CC.largest_share}",
        "expectancy_positive": "expectancy > 0", "profit_factor_gt_1": "profit_factor > 1", "drawdown_recovery": f"recovery_ratio >= {CC.recovery}", "ordinary_bootstrap": "lower > 0",
        "block_bootstrap": "block_lower > 0", "probability_positive": "probability_positive >= 0.95", "holm": f"p_holm <= {CC.alpha}",
    }
    failed = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{g}' END" for g, c in gates.items())
    return f"""SELECT *, failed = '' AS qualifies FROM (SELECT *, concat_ws(',', {failed}) AS failed FROM (SELECT *, CASE WHEN max_drawdown = 0 AND net_profit > 0 THEN 'inf'::DOUBLE WHEN max_drawdown > 0 THEN net_profit / max_drawdown ELSE 0 END AS recovery_ratio
FROM (SELECT {k}, {TRADE} FROM {runs} GROUP BY {k}) JOIN ({drawdown_sql(runs, k)}) USING ({k}) LEFT JOIN (SELECT {k}, p_value, p_holm FROM ({holm(f'SELECT {k}, p_value FROM ({hac_sql(runs, k)})', 'fold, model', 'cand')})) USING ({k})
JOIN ({diversity(runs, k, CC.series_trades)}) USING ({k}) LEFT JOIN ({boot(runs, k, CC.reps, CC.seed, CC.low)}) USING ({k}) LEFT JOIN ({block_boot(runs, k, CC.reps, CC.seed + 1, CC.low)}) USING ({k})))"""


fragment("x_cert_points", f"SELECT *, {ID7} AS cand FROM x_grid WHERE pairset = 'all' AND n >= 15")
fragment("x_cert_hits", f"SELECT * FROM (SELECT *, {ID7} AS cand FROM x_grid_hits WHERE global_split = 'confirmation' AND pairset = 'all') WHERE cand IN (SELECT cand FROM x_cert_points)")
fragment("x_cert_bounds", bounds_sql("(SELECT * FROM x_rec WHERE global_split = 'confirmation')"))
fragment("x_cert_runs", f"SELECT cand, fold, model, ts, pair, outcome_pips - cost AS v FROM ({kept_sql('x_cert_hits', 'x_cert_bounds')}), {_MODELS}")
fragment("x_cert_cells", cells_sql("x_cert_runs"))


def points(t: Tables) -> DataFrame:
    r = t.records().filter(F.col("global_split") == "discovery").withColumn("pairset", F.lit("all"))
    g = ev.grid_cells(r, cd.CELL).filter(F.col("n") >= 15)
    return t._keep("points", lambda: g.withColumn("cand", cd.candidate_id()))


def timeline(t: Tables) -> DataFrame:
    return t.records().filter(F.col("global_split") == "confirmation").withColumn("pairset", F.lit("all"))


def cert_cells(t: Tables) -> DataFrame:
    hits = ev.matching(timeline(t), points(t).select("cand", *cd.POINT), cd.CELL)
    return cd.certification_cells(hits, timeline(t), t.study.interval_s, CERTIFY)


@query("q13_certification_cells", CELLS, "SELECT * FROM x_cert_cells")
def q13(t: Tables) -> DataFrame:
    return t._keep("cert_cells", lambda: cert_cells(t)).withColumn("failed", F.array_join("failed", ","))


VERDICT = "cand qualifying_runs:i runs:i smallest_run:i stable:b state failed"


def final_sql(cells: str, stability: str) -> str:
    gates = {
        "all_runs_qualify": f"qualifying_runs = {CC.folds}", "runs": f"runs = {CC.folds}", "trades_per_run": f"smallest_run >= {CC.trades}", "series_per_run": f"series >= {CC.series}",
        "positive_series_per_run": f"positive >= {CC.positive_series}", "walk_forward_stability": "gain", "parameter_stability": "stable", "drawdown_recovery": "recovers",
        "bootstrap_robustness": "boot", "multiple_testing_holm": "holm", "execution_cost_robustness": "gain", "aggregate_positive": "net > 0", "aggregate_pf_gt_1": "won > lost",
    }
    failed = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{g}' END" for g, c in gates.items())
    return f"""SELECT *, CASE WHEN runs <> {CC.folds} OR smallest_run < 2 THEN 'INCOMPLETE' WHEN failed = '' THEN 'PASS' ELSE 'FAIL' END AS state FROM (SELECT *, concat_ws(',', {failed}) AS failed FROM
(SELECT cand, count(*) FILTER (ok AND models = 3 AND n >= {CC.trades}) AS qualifying_runs, count(*) AS runs, min(n) AS smallest_run, min(s) AS series, min(p) AS positive, bool_and(g) AS gain, bool_and(r) AS recovers, bool_and(h) AS holm, bool_and(b) AS boot
 FROM (SELECT cand, fold, bool_and(qualifies) AS ok, count(*) AS models, max(n) AS n, min(eligible_pairs) AS s, min(positive_pairs) AS p, bool_and(expectancy > 0) AS g, bool_and(recovery_ratio >= 1) AS r, bool_and(coalesce(p_holm <= {CC.alpha}, false)) AS h,
  bool_and(coalesce(lower > 0 AND block_lower > 0 AND probability_positive >= 0.95, false)) AS b FROM {cells} GROUP BY 1, 2) GROUP BY 1)
JOIN (SELECT cand, sum(net_profit) AS net, sum(win_rate * n * avg_win) AS won, won - sum(net_profit) AS lost FROM {cells} WHERE model = 'realistic' GROUP BY 1) USING (cand) LEFT JOIN ({stability}) USING (cand))"""


def stable_sql(hits: str, bounds: str) -> str:
    good = " AND ".join(f"(count(*) >= {CC.trades} AND {survives_sql(c)})" for c in (0.4, 0.8, 1.5))
    return f"""SELECT base AS cand, count(*) AS variants, bool_and(coalesce(w AND r AND runs = {CC.folds}, false)) AS stable FROM (SELECT base, cand, {good} AS w FROM {hits} GROUP BY 1, 2)
LEFT JOIN (SELECT base, cand, bool_and(g) AS r, count(*) AS runs FROM (SELECT base, cand, fold, {good} AS g FROM ({kept_sql(hits, bounds)}) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (base, cand) GROUP BY 1"""


fragment("x_variants", """
SELECT v.* REPLACE (least(0.99, greatest(0.01, agreement_min * (1 + d))) AS agreement_min), cand || '~a' || d AS variant FROM x_cert_points v, x_shifts UNION ALL
SELECT v.* REPLACE (greatest(0.01, distance_max * (1 + d)) AS distance_max), cand || '~d' || d FROM x_cert_points v, x_shifts WHERE distance_max IS NOT NULL""")
fragment("x_shifts", "SELECT unnest([-0.10, -0.05, 0.05, 0.10])::DOUBLE AS d")
fragment("x_variant_hits", """
SELECT r.*, v.cand AS base, v.variant AS cand FROM (SELECT *, outcome_pips AS v FROM x_rec WHERE global_split = 'confirmation') r JOIN x_variants v USING (horizon, regime, session, direction)
WHERE r.agreement >= v.agreement_min AND (v.distance_max IS NULL OR r.median_distance <= v.distance_max)""")


@query("q13_purged_certification", VERDICT, final_sql("x_cert_cells", stable_sql("x_variant_hits", "x_cert_bounds")))
def q13b(t: Tables) -> DataFrame:
    cells = t._keep("cert_cells", lambda: cert_cells(t))
    hits = ev.matching(timeline(t), cd.variants(points(t)).select("base", "cand", *cd.POINT), cd.CELL)
    stability = cd.variant_stability(hits, timeline(t), t.study.interval_s, CERTIFY)
    return cd.certification(cells, stability, CERTIFY).withColumn("failed", F.array_join("failed", ","))


fragment("x_cert2_bounds", bounds_sql("x_two_hits"))
fragment("x_cert2_runs", f"SELECT cand, fold, model, ts, pair, outcome_pips - cost AS v FROM ({kept_sql('x_two_hits', 'x_cert2_bounds')}), {_MODELS}")
fragment("x_cert2_cells", cells_sql("x_cert2_runs"))
fragment("x_variant2_hits", "SELECT a.*, b.cand AS base FROM x_two_hits a JOIN (SELECT DISTINCT cand, horizon, k FROM x_two_hits) b ON a.horizon = b.horizon AND a.k <> b.k")


@query("q14_two_sided_certification", VERDICT, final_sql("x_cert2_cells", stable_sql("x_variant2_hits", "x_cert2_bounds")))
def q14(t: Tables) -> DataFrame:
    hits = two_hits(t)
    cells = written(cd.certification_cells(hits, hits, t.study.interval_s, CERTIFY), "cells")
    bases = hits.select(F.col("cand").alias("base"), "horizon", F.col("k").alias("_k")).distinct()
    others = hits.join(F.broadcast(bases), "horizon").filter(F.col("k") != F.col("_k"))
    stability = cd.variant_stability(others, hits, t.study.interval_s, CERTIFY)
    return cd.certification(cells, stability, CERTIFY).withColumn("failed", F.array_join("failed", ","))


# ---- atlases

fragment("x_atlas_rows", f"SELECT r.* FROM x_rich r JOIN (SELECT {ATLAS} FROM x_cells WHERE split = 'confirmation' AND n >= {ATLAS_STRONG}) USING ({ATLAS})")
fragment("x_atlas", f"""
SELECT *, CASE WHEN n < {ATLAS_MINIMUM} THEN 'UNKNOWN' WHEN expectancy <= 0 OR profit_factor IS NULL OR profit_factor <= 1 THEN 'NO_TRADE'
  WHEN n >= {ATLAS_STRONG} AND (lower IS NULL OR lower > 0) AND stability >= 0.67 THEN 'STRONG_CONTEXT' ELSE 'WATCH_CONTEXT' END AS status
FROM x_cells LEFT JOIN ({boot('x_atlas_rows', ATLAS, ATLAS_REPS, ATLAS_SEED, ATLAS_LOW, ATLAS_HIGH)}) USING ({ATLAS})""")

@query(
    "q17_data_connected_relations", "horizon:i pair_a pair_b points:i zero_lag:d strongest_lag:i strongest:d",
    """SELECT horizon, pair_a, pair_b, points, max(correlation) FILTER (lag = 0) AS zero_lag, first(lag ORDER BY abs(correlation) DESC, lag) AS strongest_lag, first(correlation ORDER BY abs(correlation) DESC, lag) AS strongest
FROM x_lagged GROUP BY 1, 2, 3, 4""",
)
def q17(t: Tables) -> DataFrame:
    from barline.catalog.evidence import lagged

    return paths.strongest_lag(lagged(t), ["horizon", "pair_a", "pair_b"])


@query(
    "q17_data_connected_atlas", "kind horizon:i a:d b:d c:d d:d",
    f"""SELECT 'calibration' AS kind, horizon, count(*) AS a, avg(agreement) AS b, {WIN} AS c, NULL AS d FROM {REC} GROUP BY 2
UNION ALL SELECT 'cost_stress', horizon, avg(v), avg(v) - 0.5, avg(v) - 1.0, avg(v) - 2.0 FROM {REC} GROUP BY 2
UNION ALL SELECT 'drift', 0, abs(avg(v) FILTER (split = 'confirmation') - avg(v) FILTER (split = 'discovery')), stddev_pop(v) FILTER (split = 'confirmation') / stddev_pop(v) FILTER (split = 'discovery'), 0, NULL FROM {REC}""",
)
def q17b(t: Tables) -> DataFrame:
    from barline.catalog.evidence import a16

    none = F.lit(None).cast("double")
    cal = a16(t).select(F.lit("calibration").alias("kind"), "horizon", F.col("n").cast("double").alias("a"), F.col("mean_agreement").alias("b"), F.col("positive_rate").alias("c"), none.alias("d"))
    curve = ev.cost_curve(t.records(), ["horizon"], (0.0, 0.5, 1.0, 2.0)).groupBy("horizon").pivot("cost", [0.0, 0.5, 1.0, 2.0]).agg(F.first("expectancy"))
    stress = curve.toDF("horizon", "a", "b", "c", "d").withColumn("kind", F.lit("cost_stress")).select("kind", "horizon", "a", "b", "c", "d")
    r = t.records().withColumn("w", F.when(F.col("split") == "discovery", "reference").when(F.col("split") == "confirmation", "current")).withColumn("_all", F.lit(0))
    moved = ev.drift(r, ["_all"], "w", "outcome_pips").select(
        F.lit("drift").alias("kind"), F.lit(0).cast("bigint").alias("horizon"), F.col("mean_shift").alias("a"), F.col("volatility_ratio").alias("b"), F.col("missing_shift").alias("c"), none.alias("d")
    )
    return cal.unionByName(stress).unionByName(moved)


HIER = "spec key n:i expectancy:d profit_factor:d stability:d lower:d status"
fragment("x_hier_pick", """SELECT spec, key FROM (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY round(expectancy, 6) DESC, round(profit_factor, 6) DESC NULLS LAST, n DESC, key) AS rank FROM x_hier WHERE split = 'discovery' AND n >= 10 AND expectancy > 0 AND profit_factor > 1) WHERE rank <= 20""")
fragment("x_hier_rows", """SELECT spec, key, split, ts, pair, horizon, v FROM (SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{k}' AS spec, {e} AS key, split, ts, pair, horizon, outcome_pips AS v FROM x_rec" for k, e in {
        "pair_horizon_regime_direction": "pair || '|' || horizon || '|' || regime || '|' || direction",
        "pair_horizon_regime_session_direction": "pair || '|' || horizon || '|' || regime || '|' || session || '|' || direction",
        "pair_horizon_regime_session": "pair || '|' || horizon || '|' || regime || '|' || session",
    }.items()) + ")) JOIN x_hier_pick USING (spec, key) JOIN (SELECT spec, key FROM x_hier WHERE split = 'confirmation' AND n >= 5) USING (spec, key) WHERE split = 'confirmation'")


@query(
    "q16_hierarchical_validation", HIER,
    f"""SELECT c.*, b.lower, CASE WHEN n >= 5 AND profit_factor IS NOT NULL AND coalesce(lower > 0, false) AND stability >= 2/3 THEN 'STRONG_CONTEXT' WHEN n >= 5 AND (expectancy > 0 OR coalesce(profit_factor > 1, false)) THEN 'WATCH_CONTEXT' ELSE 'NO_TRADE' END AS status
FROM x_hier c JOIN x_hier_pick USING (spec, key) JOIN ({boot('x_hier_rows', 'spec, key', 1000, 7, 25)}) b USING (spec, key) WHERE c.split = 'confirmation' AND c.n >= 5""",
)
def q16(t: Tables) -> DataFrame:
    from barline.plans.atlas import hierarchical_validation

    return hierarchical_validation(t.records(), discovery_n=10, confirmation_n=5, reps=1000, low=25, seed=7)


@query(
    "q15_context_atlas", "status cells:i rows:i expectancy:d strongest:d",
    "SELECT status, count(*) AS cells, sum(n) AS rows, sum(expectancy * n) / sum(n) AS expectancy, max(expectancy) AS strongest FROM x_atlas WHERE split = 'confirmation' GROUP BY 1",
)
def q15(t: Tables) -> DataFrame:

    c = atlas_cells(t).filter(F.col("split") == "confirmation")
    return c.groupBy("status").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"), (F.sum(F.col("expectancy") * F.col("n")) / F.sum("n")).alias("expectancy"), F.max("expectancy").alias("strongest")
    )


@query(
    "q19_report_audit", "spec grp horizon:i n:i expectancy:d profit_factor:d positive_pairs:i survivors:i strict:i",
    f"""SELECT * FROM x_rollup JOIN (SELECT spec, grp, horizon, count(*) FILTER (expectancy > 0 AND profit_factor > 1) AS survivors, count(*) FILTER (expectancy > 0 AND profit_factor > 1 AND low > 0.5) AS strict
FROM (SELECT *, {wilson_sql("win_rate", "n", False)[0]} AS low FROM x_audit_cells WHERE n >= 20) GROUP BY 1, 2, 3) USING (spec, grp, horizon)""",
)
def q19(t: Tables) -> DataFrame:
    from barline.functions.statistics import wilson

    cells = audit_cells(t).filter(F.col("n") >= 20)
    low, _ = wilson(F.col("win_rate"), F.col("n"), clamp=False)
    strict = cells.withColumn("low", low).groupBy("spec", "grp", "horizon").agg(
        F.count_if(ev.survives()).alias("survivors"), F.count_if(ev.survives() & (F.col("low") > 0.5)).alias("strict")
    )
    return rolled_up(cells).join(strict, ["spec", "grp", "horizon"])
