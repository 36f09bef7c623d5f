"""Bootstrap, ruin, HAC, multiple testing, logistic calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.catalog.evidence import REC, drawdown_sql
from barline.catalog.registry import Tables, fragment, query
from barline.operators import draws
from barline.operators import evidence as ev
from barline.operators import inference as inf
from barline.operators import paths

KEYS = ["horizon", "direction"]
REPS, SIMULATIONS = 1000, 5000


def mixed_sql(body: str, name: str) -> str:
    for _ in range(2):
        body = f"SELECT * REPLACE (xor({name}, {name} >> 16) AS {name}) FROM ({body})"
        body = f"SELECT * REPLACE (({name} * {draws.MIX}) & {draws.MASK} AS {name}) FROM ({body})"
    return f"SELECT * REPLACE (xor({name}, {name} >> 16) AS {name}) FROM ({body})"


def draws_sql(source: str, keys: str, reps: int, seed: int, steps: str, size: str) -> str:
    body = f"SELECT {keys}, rep, CAST({steps} AS BIGINT) AS steps, CAST({size} AS BIGINT) AS size, CAST(({seed} + rep * {draws.STEP}) & {draws.MASK} AS BIGINT) AS a FROM {source}, (SELECT unnest(generate_series(0, {reps - 1})) AS rep)"
    body = mixed_sql(body, "a")
    body = f"SELECT {keys}, rep, size, step, CAST(xor(a, (step * {draws.STEP}) & {draws.MASK}) AS BIGINT) AS low FROM (SELECT *, unnest(generate_series(0, steps - 1)) AS step FROM ({body}))"
    words = f"SELECT *, CAST(xor(low, {draws.MIX}) AS BIGINT) AS high FROM ({mixed_sql(body, 'low')})"
    return f"SELECT {keys}, rep, step, (high * 2147483648 + low) % size AS rn FROM ({mixed_sql(words, 'high')})"


fragment("x_sample", f"SELECT *, row_number() OVER (PARTITION BY horizon, direction ORDER BY ts, pair) - 1 AS rn FROM {REC} WHERE split = 'confirmation'")
fragment("x_sizes", "SELECT horizon, direction, count(*) AS n FROM x_sample GROUP BY 1, 2")


def boot_sql(seed: int, reps: int = REPS) -> str:
    return f"SELECT horizon, direction, rep, avg(v) AS mean FROM ({draws_sql('x_sizes', 'horizon, direction', reps, seed, 'n', 'n')}) JOIN x_sample USING (horizon, direction, rn) GROUP BY 1, 2, 3"


fragment("x_blocks", """
SELECT horizon, direction, rn // 5 AS rn, count(*) AS len, list(v ORDER BY rn) AS vs FROM x_sample GROUP BY horizon, direction, rn // 5""")
fragment("x_block_sizes", "SELECT *, CAST(ceil(n / 5) AS BIGINT) AS blocks, CASE WHEN n % 5 = 0 THEN n // 5 ELSE CAST(ceil(n / (n % 5)) AS BIGINT) END AS steps FROM x_sizes")


def block_sql(seed: int, reps: int = REPS) -> str:
    return f"""SELECT horizon, direction, rep, sum(list_sum(vs[1:least(len, n - before)])) / max(n) AS mean FROM (SELECT *, coalesce(sum(len) OVER (PARTITION BY horizon, direction, rep ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
 FROM ({draws_sql('x_block_sizes', 'horizon, direction', reps, seed, 'steps', 'blocks')}) JOIN x_blocks USING (horizon, direction, rn) JOIN x_sizes USING (horizon, direction)) WHERE before < n GROUP BY 1, 2, 3"""


def stats_sql(means: str, low: int, high: int) -> str:
    return f"""SELECT horizon, direction, max(mean) FILTER (r = {low}) AS lower, max(mean) FILTER (r = {high}) AS upper, avg(CAST(mean > 0 AS INT)) AS probability_positive
FROM (SELECT *, row_number() OVER (PARTITION BY horizon, direction ORDER BY mean, rep) - 1 AS r FROM ({means})) GROUP BY 1, 2"""


def ruin_sql(seed: int, simulations: int, cost: float) -> str:
    return f"""SELECT horizon, direction, avg(CAST(low <= 0 AS INT)) AS ruin_probability FROM (SELECT horizon, direction, rep, min(capital) AS low FROM (SELECT *, 20 + sum(v - {cost}::DOUBLE) OVER (PARTITION BY horizon, direction, rep ORDER BY step ROWS UNBOUNDED PRECEDING) AS capital
 FROM ({draws_sql('x_sizes', 'horizon, direction', simulations, seed, 'n', 'n')}) JOIN x_sample USING (horizon, direction, rn)) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


def sample(t: Tables) -> DataFrame:
    c = t.records().filter(F.col("split") == "confirmation").select(*KEYS, "ts", "pair", "outcome_pips")
    return paths.ranked(c, KEYS)


LOW, HIGH = REPS // 40 - 1, REPS - REPS // 40
BOUNDS = "horizon:i direction lower:d upper:d probability_positive:d"


@query("b1_bootstrap_means", BOUNDS, stats_sql(boot_sql(11), LOW, HIGH))
def b1(t: Tables) -> DataFrame:
    return inf.order_statistics(inf.bootstrap_means(sample(t), KEYS, "outcome_pips", REPS, 11), KEYS, LOW, HIGH)


@query("b2_block_bootstrap", BOUNDS, stats_sql(block_sql(12), LOW, HIGH))
def b2(t: Tables) -> DataFrame:
    return inf.order_statistics(inf.block_bootstrap_means(sample(t), KEYS, "outcome_pips", 5, REPS, 12), KEYS, LOW, HIGH)


@query("b3_probability_positive", "horizon:i direction p:d", f"SELECT horizon, direction, avg(CAST(mean > 0 AS INT)) AS p FROM ({boot_sql(13)}) GROUP BY 1, 2")
def b3(t: Tables) -> DataFrame:
    m = inf.bootstrap_means(sample(t), KEYS, "outcome_pips", REPS, 13)
    return m.groupBy(*KEYS).agg(F.avg((F.col("mean") > 0).cast("double")).alias("p"))


@query("b4_ruin_probability", "horizon:i direction ruin_probability:d", ruin_sql(14, SIMULATIONS, 0.2))
def b4(t: Tables) -> DataFrame:
    return inf.ruin_probability(sample(t), KEYS, "outcome_pips", 20.0, SIMULATIONS, 14, 0.2)


@query(
    "b5_distribution_audit", "horizon:i direction mean:d lower:d upper:d probability_positive:d max_drawdown:d ruin_probability:d",
    f"""SELECT a.horizon, a.direction, m.mean, least(a.lower, b.lower) AS lower, greatest(a.upper, b.upper) AS upper, a.probability_positive, d.max_drawdown, r.ruin_probability
FROM ({stats_sql(boot_sql(21), LOW, HIGH)}) a JOIN ({stats_sql(block_sql(22), LOW, HIGH)}) b USING (horizon, direction) JOIN ({ruin_sql(23, SIMULATIONS, 0.0)}) r USING (horizon, direction)
JOIN (SELECT horizon, direction, avg(v) AS mean FROM x_sample GROUP BY 1, 2) m USING (horizon, direction) JOIN ({drawdown_sql('x_sample', 'horizon, direction')}) d USING (horizon, direction)""",
)
def b5(t: Tables) -> DataFrame:
    s = sample(t)
    return inf.distribution_audit(s, KEYS, "outcome_pips", paths.drawdown(s, KEYS, "outcome_pips"), 20.0, REPS, 21, LOW)


def erfc_sql(x: str) -> str:
    """Near 0 by the alternating series of erf, else by trapezoids of Craig's integral of exp(-(x / sin t)^2) over a quarter turn."""
    n = 200
    points = f"list_transform(range(1, {n}), lambda i: exp(-pow({x} / sin(i * pi() / {2 * n}), 2)))"
    half = f"((2 * list_sum({points}) + exp(-pow({x}, 2))) / {2 * n})"
    near = f"list_sum(list_transform(range(0, 40), lambda i: pow(-1, i) * pow({x}, 2 * i + 1) / (gamma(i + 1) * (2 * i + 1))))"
    return f"CASE WHEN abs({x}) < 1.5 THEN 1 - 2 / sqrt(pi()) * {near} WHEN {x} > 0 THEN {half} ELSE 2 - {half} END"


def hac_sql(source: str, keys: str, order: str = "ts, pair") -> str:
    gammas = ", ".join(f"avg(c * l{k}) AS g{k}" for k in range(1, 6))
    lags = ", ".join(f"lag(c, {k}) OVER w AS l{k}" for k in range(1, 6))
    var = "g0 + " + " + ".join(f"{2 * (1 - k / 6)!r}::DOUBLE * g{k}" for k in range(1, 6))
    return f"""SELECT {keys}, n, mean, se, CASE WHEN se = 0 THEN CASE WHEN mean > 0 THEN 0 ELSE 1 END ELSE 0.5 * ({erfc_sql('z')}) END AS p_value
FROM (SELECT *, mean / nullif(se, 0) / sqrt(2) AS z FROM (SELECT *, sqrt(greatest({var}, 0) / n) AS se FROM (SELECT {keys}, any_value(n) AS n, any_value(mean) AS mean, avg(c * c) AS g0, {gammas}
 FROM (SELECT *, {lags} FROM (SELECT *, v - mean AS c FROM (SELECT *, avg(v) OVER (PARTITION BY {keys}) AS mean, count(*) OVER (PARTITION BY {keys}) AS n FROM {source})) WINDOW w AS (PARTITION BY {keys} ORDER BY {order}))
 WHERE n > 5 GROUP BY {keys})))"""


FAMILY = ["horizon", "regime", "direction"]
fragment("x_hac", hac_sql(REC, "horizon, regime, direction"))
fragment("x_adjusted", """
SELECT *, least(1, p_value * m) AS p_bonferroni, max(least(1, (m - rn + 1) * p_value)) OVER (ORDER BY rn) AS p_holm, min(least(1, p_value * m / rn)) OVER (ORDER BY rn DESC) AS p_bh
FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, horizon, regime, direction) AS rn FROM x_hac)""")


def hac(t: Tables) -> DataFrame:
    return inf.hac_pvalue(t.records(), FAMILY, "outcome_pips")


@query("b6_hac_pvalue", "horizon:i regime direction n:i mean:d se:d p_value:d", "SELECT * FROM x_hac")
def b6(t: Tables) -> DataFrame:
    return hac(t)


@query("b7_bonferroni", "horizon:i regime direction p_bonferroni:d", "SELECT * FROM x_adjusted")
def b7(t: Tables) -> DataFrame:
    return inf.adjust(hac(t), "p_value", FAMILY)


@query("b8_holm", "horizon:i regime direction p_holm:d", "SELECT * FROM x_adjusted")
def b8(t: Tables) -> DataFrame:
    return inf.adjust(hac(t), "p_value", FAMILY)


@query("b9_benjamini_hochberg", "horizon:i regime direction p_bh:d", "SELECT * FROM x_adjusted")
def b9(t: Tables) -> DataFrame:
    return inf.adjust(hac(t), "p_value", FAMILY)


# The descent as a recursion over one list of score counts per cohort.
_STEP = "list_sum(list_transform(rows, lambda r: (1 / (1 + exp(-(a + b * r.x))) - r.y) * r.n{0})) / n"
fragment("x_fit", f"""
WITH RECURSIVE c AS (SELECT horizon, agreement AS x, CAST(outcome_pips > 0 AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS n FROM x_rec WHERE split = 'discovery' GROUP BY 1, 2, 3),
l AS (SELECT horizon, list({{'x': x, 'y': y, 'n': n}} ORDER BY x, y) AS rows, sum(n) AS n FROM c GROUP BY 1 HAVING sum(n) >= 20),
d AS (SELECT horizon, 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM l UNION ALL
 SELECT horizon, i + 1, a - 0.05::DOUBLE * {_STEP.format("")}, b - 0.05::DOUBLE * {_STEP.format(" * r.x")} FROM d JOIN l USING (horizon) WHERE i < 1200)
SELECT horizon, a AS intercept, b AS slope, n FROM d JOIN l USING (horizon) WHERE i = 1200""")


@query("b10_logistic_fit", "horizon:i intercept:d slope:d n:i", "SELECT * FROM x_fit")
def b10(t: Tables) -> DataFrame:
    return fitted(t)


def fitted(t: Tables) -> DataFrame:
    d = t.records().filter(F.col("split") == "discovery").withColumn("won", (F.col("outcome_pips") > 0).cast("int"))
    return t._keep("logistic", lambda: inf.fit_logistic(d, ["horizon"], "agreement", "won"))


@query(
    "b10_logistic_validation", "split horizon:i n:i brier:d ece:d",
    """SELECT split, horizon, sum(k) AS n, sum(se) / sum(k) AS brier, sum(k * abs(mp - rate)) / sum(k) AS ece FROM (SELECT split, horizon, least(floor(p * 10), 9) AS bin, count(*) AS k, avg(p) AS mp, avg(y) AS rate, sum((p - y) ** 2) AS se
 FROM (SELECT split, horizon, 1 / (1 + exp(-(intercept + slope * agreement))) AS p, CAST(outcome_pips > 0 AS DOUBLE) AS y FROM x_rec JOIN x_fit USING (horizon) WHERE split IN ('discovery', 'confirmation')) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def b10v(t: Tables) -> DataFrame:
    """The report on the training rows next to the one on the held-out rows."""
    from barline.functions.statistics import logistic

    rows = t.records().filter(F.col("split").isin("discovery", "confirmation")).withColumn("won", (F.col("outcome_pips") > 0).cast("int"))
    judged = rows.join(fitted(t).drop("n"), "horizon").withColumn("p", logistic(F.col("intercept") + F.col("slope") * F.col("agreement")))
    return ev.calibration(ev.calibration_bins(judged, ["split", "horizon"], "p", "won"), ["split", "horizon"])
