"""Statistics as Column expressions and aggregate expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.functions.labels import col

# Fixed value: the two-sided 95 % normal quantile.
Z95 = 1.959963984540054

# Terms of the power series and depth of the continued fraction of erfc, enough for double precision on either side of 2.
SERIES, DEPTH = 40, 80


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero."""
    return a / F.nullif(b, F.lit(0))


def wilson(rate: Column, n: Column, clamp: bool = True, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval for a share; null for an empty sample."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    denominator = 1 + z * z / m
    centre = (rate + z * z / (2 * m)) / denominator
    half = z * F.sqrt(rate * (1 - rate) / m + z * z / (4 * m * m)) / denominator
    low, high = centre - half, centre + half
    return (F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)) if clamp else (low, high)


def erfc(x: Column) -> Column:
    """Complementary error function to about 1e-13 relative: its power series below 2, its continued fraction above."""
    z = F.abs(x)
    down = lambda n: F.sequence(F.lit(n), F.lit(1))
    series = F.aggregate(down(SERIES), F.lit(1.0), lambda s, k: 1 + s * (2 * z * z / (2 * k + 1)))
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * z * series
    wide = F.greatest(z, F.lit(1.0))
    fraction = F.aggregate(down(DEPTH), wide, lambda f, k: wide + k / 2 / f)
    tail = F.when(z < 2, near).otherwise(F.exp(-z * z) / (math.sqrt(math.pi) * fraction))
    return F.when(x >= 0, tail).otherwise(2 - tail)


def upper_tail(mean: Column, se: Column) -> Column:
    """One-sided normal p-value for a positive mean; a zero error decides by the sign."""
    return F.when(se == 0, F.when(mean > 0, 0.0).otherwise(1.0)).otherwise(0.5 * erfc(mean / se / F.sqrt(F.lit(2.0))))


def logistic(z: Column) -> Column:
    """Logistic probability that does not overflow on either side."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def gains(value: str | Column) -> Column:
    v = col(value)
    return F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0))


def losses(value: str | Column) -> Column:
    v = col(value)
    return F.coalesce(-F.sum(F.when(v < 0, v)), F.lit(0.0))


def profit_factor(value: str | Column) -> Column:
    """Gross gains over gross losses; null without a loss."""
    return ratio(gains(value), losses(value))


def win_rate(value: str | Column) -> Column:
    return F.avg((col(value) > 0).cast("double"))


def trade_statistics(value: str | Column, cost: float | Column = 0.0) -> list[Column]:
    """n, expectancy, win rate, average win, average loss and profit factor after a cost per trade."""
    v = col(value) - (F.lit(cost) if isinstance(cost, (int, float)) else cost)
    return [
        F.count(v).alias("n"),
        F.avg(v).alias("expectancy"),
        win_rate(v).alias("win_rate"),
        F.coalesce(F.avg(F.when(v > 0, v)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(v < 0, v)), F.lit(0.0)).alias("avg_loss"),
        profit_factor(v).alias("profit_factor"),
    ]


def pearson(a: str | Column, b: str | Column) -> Column:
    """Correlation of the rows with both values, 0 where a side is constant."""
    x, y = F.when(col(b).isNotNull(), col(a)), F.when(col(a).isNotNull(), col(b))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))
