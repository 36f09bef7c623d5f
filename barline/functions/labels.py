"""Labels and bands as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pip sizes.
YEN_PIP = 0.01
PIP = 0.0001


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def session_label(ts: str | Column) -> Column:
    """Trading session by UTC hour: asia before 7, london before 13, new_york before 21, else rollover."""
    h = F.hour(col(ts))
    return F.when(h < 7, "asia").when(h < 13, "london").when(h < 21, "new_york").otherwise("rollover")


def regime(trend: Column, strength: Column, vol_z: Column, breakout: Column) -> Column:
    """Market regime: breakout first, then high volatility, then trend, then range."""
    quiet = F.when(vol_z <= -1, "range_low_vol").otherwise("range_normal")
    trending = F.when(trend > 0, "trend_up").otherwise("trend_down")
    loud = (
        F.when((strength > 0.5) & (trend > 0), "high_vol_trend_up")
        .when((strength > 0.5) & (trend < 0), "high_vol_trend_down")
        .otherwise("high_volatility_range")
    )
    return (
        F.when(breakout > 0, "breakout_up")
        .when(breakout < 0, "breakout_down")
        .when(vol_z >= 1, loud)
        .when(strength >= 0.5, trending)
        .otherwise(quiet)
    )


def normal_symbol(symbol: str | Column, separators: str = "/_-") -> Column:
    """Symbol without separators, upper case."""
    return F.upper(F.translate(F.trim(col(symbol)), separators, ""))


def pip_size(pair: str | Column) -> Column:
    return F.when(col(pair).endswith("/JPY"), YEN_PIP).otherwise(PIP)


def pairsets(pair: str | Column) -> Column:
    """Every pair belongs to ``all``; yen pairs also to ``JPY``."""
    return F.when(col(pair).endswith("/JPY"), F.array(F.lit("all"), F.lit("JPY"))).otherwise(F.array(F.lit("all")))


def agreement_band(value: str | Column) -> Column:
    v = col(value)
    return (
        F.when(v < 0.5, "<0.50").when(v < 0.6, "0.50-0.59").when(v < 0.7, "0.60-0.69").when(v < 0.8, "0.70-0.79")
        .otherwise("0.80+")
    )


def distance_band(value: str | Column) -> Column:
    v = col(value)
    return (
        F.when(v <= 0.5, "<=0.50").when(v <= 1.0, "0.51-1.00").when(v <= 1.5, "1.01-1.50")
        .when(v <= 2.0, "1.51-2.00").otherwise(">2.00")
    )


def outcome_sign(value: str | Column) -> Column:
    v = col(value)
    return F.when(v > 0, "win").when(v < 0, "loss").otherwise("flat")


def weekday_name(ts: str | Column) -> Column:
    return F.lower(F.date_format(col(ts), "EEEE"))


def hour_block(ts: str | Column) -> Column:
    h = F.hour(col(ts))
    return F.format_string("%02d:00-%02d", h, (h + 1) % 24)


def momentum_direction(momentum: str | Column) -> Column:
    return F.when(col(momentum) >= 0, "long").otherwise("short")
