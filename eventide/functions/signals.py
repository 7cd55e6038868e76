"""Labels and trading signals attached to aggregated results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Thresholds and names shown to the user.
DRIFT_THRESHOLD = 0.0005
STRONG_THRESHOLD = 0.001
REGIME_NAMES = {1: "Low Volatility", 2: "Medium Volatility", 3: "High Volatility"}


def decile_label(decile: Column) -> Column:
    return (
        F.when(decile <= 2, "Very Low")
        .when(decile <= 4, "Low")
        .when(decile <= 6, "Medium")
        .when(decile <= 8, "High")
        .otherwise("Very High")
    )


def three_way(value: Column, up: str, down: str, threshold: float = DRIFT_THRESHOLD) -> Column:
    """``up`` above the threshold, ``down`` below its negative, otherwise Neutral."""
    return F.when(value > threshold, up).when(value < -threshold, down).otherwise("Neutral")


def strength(value: Column) -> Column:
    """Four-way signal; exactly zero counts as Short."""
    return (
        F.when(value > STRONG_THRESHOLD, "Strong Long")
        .when(value > 0, "Long")
        .when(value < -STRONG_THRESHOLD, "Strong Short")
        .otherwise("Short")
    )


def regime_label(regime: Column) -> Column:
    label = F.concat(F.lit("Regime "), regime.cast("string"))
    for number, name in REGIME_NAMES.items():
        label = F.when(regime == number, name).otherwise(label)
    return label


def quality_tier(n_klines: Column, n_events: Column) -> Column:
    return F.when((n_klines > 0) & (n_events > 0), "good").when(n_klines > 0, "partial").otherwise("missing")
