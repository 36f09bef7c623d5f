"""Bar predicates as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("bid", "ask")
FIELDS = ("open", "high", "low", "close")


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def geometry_ok(prefix: str = "") -> Column:
    """high and low enclose open and close."""
    o, h, lo, c = (F.col(f"{prefix}{f}") for f in FIELDS)
    return (h >= F.greatest(o, c)) & (lo <= F.least(o, c)) & (lo <= h)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def numbers_ok() -> Column:
    """All eight prices are finite and positive."""
    return every([finite(F.col(f"{s}_{f}")) & (F.col(f"{s}_{f}") > 0) for s in SIDES for f in FIELDS])


def spreads_ok() -> Column:
    """Given spreads are finite, not negative, and not zero where the prices differ."""
    given = every(
        [F.col(f"spread_{f}").isNull() | (finite(F.col(f"spread_{f}")) & (F.col(f"spread_{f}") >= 0)) for f in FIELDS]
    )
    consistent = every(
        [
            F.col(f"spread_{f}").isNull() | (F.col(f"spread_{f}") != 0) | (F.col(f"ask_{f}") == F.col(f"bid_{f}"))
            for f in ("open", "close")
        ]
    )
    return given & consistent


def crossed() -> Column:
    """The ask is below the bid at open or close."""
    return (F.col("ask_open") < F.col("bid_open")) | (F.col("ask_close") < F.col("bid_close"))


def paired_ok() -> Column:
    return numbers_ok() & geometry_ok("bid_") & geometry_ok("ask_") & ~crossed() & spreads_ok()


def bar_spread() -> Column:
    return F.coalesce(F.col("spread_close"), F.col("ask_close") - F.col("bid_close"))


def net_move(move: Column, slippage: float = 0.0, commission: float = 0.0) -> Column:
    """The spread is already paid by trading bid against ask; only other costs are taken off."""
    return move - F.lit(slippage) - F.lit(commission)
