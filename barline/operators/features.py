"""State features and rolling scalers over paired bars."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.labels import session_label
from barline.functions.prices import bar_spread
from barline.operators.ordering import in_blocks, time_block, with_positions
from barline.session import Study

# The features compared by the distance, in order.
DISTANCE_FEATURES = (
    "trend", "trend_strength", "momentum", "volatility", "atr", "range", "distance_high", "distance_low", "spread",
)


def positioned(bars: DataFrame, study: Study) -> DataFrame:
    """Bars with their position in the pair (``pos``) and the number of bars of the pair (``bars``)."""
    block = time_block("ts", study.interval_s * study.block_rows)
    return with_positions(bars, ["pair"], ["ts"], block, out="pos", total="bars")


def state_columns(window: Callable[..., object], lookback: int) -> dict[str, Column]:
    """The ten state features over the last ``lookback`` bars and the current one."""
    w, full, prior = window(), window(-lookback, 0), window(-lookback, -1)
    close, spread_range = F.col("bid_close"), F.col("bid_high") - F.col("bid_low")
    mean_close, mean_range = F.avg(close).over(full), F.avg(spread_range).over(full)
    back5, first = F.lag(close, 5).over(w), F.lag(close, lookback).over(w)
    high, low = F.max(close).over(prior), F.min(close).over(prior)
    return {
        "trend": F.when(close >= mean_close, 1.0).otherwise(-1.0),
        "trend_strength": F.least(F.lit(1.0), F.abs(close - first) / (mean_range * lookback + 1e-12)),
        "momentum": F.coalesce((close - back5) / F.nullif(back5, F.lit(0.0)), F.lit(0.0)),
        "volatility": F.coalesce(mean_range / F.nullif(mean_close, F.lit(0.0)), F.lit(0.0)),
        "atr": mean_range,
        "range": F.max(close).over(full) - F.min(close).over(full),
        "distance_high": close - high,
        "distance_low": close - low,
        "spread": bar_spread(),
        "breakout": F.when(close > high, 1.0).when(close < low, -1.0).otherwise(0.0),
    }


def states(bars: DataFrame, study: Study) -> DataFrame:
    """Feature state of every bar with enough history; bars must carry ``pos``."""

    def compute(d: DataFrame, window: Callable[..., object]) -> DataFrame:
        return d.withColumns(state_columns(window, study.lookback))

    out = in_blocks(bars, ["pair"], "pos", study.lookback, 0, compute, study.block_rows)
    return out.filter(F.col("pos") >= study.lookback)


def market_states(bars: DataFrame, study: Study, need: int = 61) -> DataFrame:
    """Short and long horizon market state; only bars with ``need`` bars of history."""

    def compute(d: DataFrame, window: Callable[..., object]) -> DataFrame:
        w = window()
        c = F.col("bid_close")
        d = d.withColumn("ret1", one_bar_return("bid_close", w))
        back = lambda n: (c - F.lag(c, n).over(w)) / F.lag(c, n).over(w)
        span = lambda n: F.max("bid_high").over(window(1 - n, 0)) - F.min("bid_low").over(window(1 - n, 0))
        mean = lambda n: F.avg(c).over(window(1 - n, 0))
        return d.withColumns(
            {
                "return_5": back(5),
                "return_20": back(20),
                "range_20": span(20),
                "range_60": span(60),
                "volatility_20": F.stddev_pop("ret1").over(window(-19, 0)),
                "volatility_60": F.stddev_pop("ret1").over(window(-59, 0)),
                "trend_20_60": (mean(20) - mean(60)) / mean(60),
                "spread": bar_spread(),
                "session": session_label("ts"),
            }
        )

    out = in_blocks(bars, ["pair"], "pos", need - 1, 0, compute, study.block_rows)
    return out.filter(F.col("pos") >= need - 1)


def one_bar_return(close: str, w: object) -> Column:
    """close / previous close - 1; 0 after a zero price."""
    previous = F.lag(close).over(w)
    return F.when(previous == 0, 0.0).otherwise(F.col(close) / previous - 1)


def one_bar_returns(bars: DataFrame, study: Study, close: str = "bid_close") -> DataFrame:
    def compute(d: DataFrame, window: Callable[..., object]) -> DataFrame:
        return d.withColumn("ret", one_bar_return(close, window()))

    return in_blocks(bars, ["pair"], "pos", 1, 0, compute, study.block_rows).filter(F.col("pos") >= 1)


def contiguous(window: Callable[..., object], interval_s: int, before: int, after: int) -> dict[str, Column]:
    """Flags: no missing bar in the ``before`` steps back / the ``after`` steps ahead (``pos``, ``bars`` needed)."""
    step = F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(window()))
    broken = (step != interval_s).cast("int")
    out = {"_broken": broken}
    out["back_ok"] = (F.col("pos") >= before) & (F.coalesce(F.sum("_broken").over(window(1 - before, 0)), F.lit(0)) == 0)
    out["ahead_ok"] = (F.col("pos") + after < F.col("bars")) & (
        F.coalesce(F.sum("_broken").over(window(1, after)), F.lit(0)) == 0
    )
    return out


def rolling_scaler(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    features: Sequence[str],
    history: int,
    block_rows: int = 4096,
    zero: float = 1.0,
) -> DataFrame:
    """Mean and sample deviation of each feature over the ``history`` rows before each row.

    Differences of running sums, so the cost does not depend on ``history``.  The sums start at the
    block (plus its halo) and are taken around the block's first value, which keeps them exact where a
    feature is constant.  A deviation of zero becomes ``zero``.
    """

    def compute(d: DataFrame, window: Callable[..., object]) -> DataFrame:
        w = window()
        upto = window(Window.unboundedPreceding, -1)
        d = d.withColumns({f"_c_{f}": F.first(f).over(window(Window.unboundedPreceding, 0)) for f in features})
        sums = {}
        for f in features:
            x = F.col(f) - F.col(f"_c_{f}")
            sums[f"_s_{f}"] = F.sum(x).over(upto)
            sums[f"_q_{f}"] = F.sum(x * x).over(upto)
        d = d.withColumns(sums)
        before = {}
        for f in features:
            for part in ("s", "q"):
                before[f"_{part}d_{f}"] = F.col(f"_{part}_{f}") - F.coalesce(
                    F.lag(f"_{part}_{f}", history).over(w), F.lit(0.0)
                )
        d = d.withColumns(before)
        n = float(history)
        out = {}
        for f in features:
            s, q = F.col(f"_sd_{f}"), F.col(f"_qd_{f}")
            var = (q - s * s / n) / max(n - 1, 1.0)
            out[f"mean_{f}"] = F.col(f"_c_{f}") + s / n
            out[f"std_{f}"] = F.when(var <= 1e-12 * q / n, zero).otherwise(F.sqrt(var))
        d = d.withColumns(out)
        return d.drop(*[f"_{p}_{f}" for p in ("c", "s", "q", "sd", "qd") for f in features])

    return in_blocks(df, keys, pos, history + 1, 0, compute, max(block_rows, 4 * history)).filter(F.col(pos) >= history)
