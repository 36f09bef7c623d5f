"""Fixed tables of the asset classes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Context features each asset class must provide.
REQUIRED_FEATURES = {
    "FOREX": ("price_structure", "trend", "volatility", "momentum", "spread", "session", "carry", "cross_asset"),
    "CRYPTO": ("price_structure", "trend", "volatility", "momentum", "spread", "liquidity", "volume", "funding", "venue_microstructure"),
    "METAL": ("price_structure", "trend", "volatility", "momentum", "spread", "session", "cross_asset", "event"),
    "COMMODITY": ("price_structure", "trend", "volatility", "spread", "session", "volume", "cross_asset", "event"),
    "EQUITY": (
        "price_structure", "trend", "volatility", "momentum", "spread", "liquidity", "volume", "calendar", "gap", "event", "cross_asset",
    ),
    "INDEX": ("price_structure", "trend", "volatility", "spread", "liquidity", "volume", "calendar", "gap", "event", "cross_asset"),
}

# Classes traded on an exchange calendar, and classes whose volume is first class.
CALENDAR_CLASSES = ("EQUITY", "INDEX")
VOLUME_CLASSES = ("CRYPTO", "COMMODITY", "EQUITY", "INDEX")


def required_features(asset_class: Column) -> Column:
    out: Column | None = None
    for name, features in REQUIRED_FEATURES.items():
        array = F.array(*[F.lit(f) for f in features])
        out = F.when(asset_class == name, array) if out is None else out.when(asset_class == name, array)
    return out


def research_contract_ok(asset_class: Column, calendar_aware: Column, volume_aware: Column) -> Column:
    """Exchange-traded classes need calendar-aware research, volume-sensitive ones volume features."""
    return (calendar_aware | ~asset_class.isin(*CALENDAR_CLASSES)) & (volume_aware | ~asset_class.isin(*VOLUME_CLASSES))
