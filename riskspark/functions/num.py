"""Numeric column helpers: engine-independent rounding, clamping, guarded division."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def rnd(c: Column, digits: int) -> Column:
    """Round half up by floor(x * 10^k + 0.5) / 10^k, the one rule used for every output value."""
    p = float(10 ** digits)
    return F.floor(c * F.lit(p) + F.lit(0.5)) / F.lit(p)


def key9(c: Column) -> Column:
    """Value used in threshold tests: insensitive to summation order."""
    return rnd(c, 9)


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def pct_change(old: Column, new: Column) -> Column:
    """Percent change against |old|; a zero base gives 0 when nothing moved and 100 otherwise."""
    return (
        F.when(old == 0, F.when(new == 0, 0.0).otherwise(100.0))
        .otherwise((new - old) / F.abs(old) * 100.0)
    )


def slope(y: Column, pos: Column) -> Column:
    """Least-squares slope over equally spaced positions; 0 with fewer than two points."""
    return F.coalesce(F.regr_slope(y, pos.cast("double")), F.lit(0.0))


def unfavourable(delta: Column, polarity: Column) -> Column:
    """True when a move increases risk; neutral metrics never do."""
    return (
        F.when(F.abs(delta) < 1e-9, False)
        .when(polarity == "higher_is_better", delta < 0)
        .when(polarity == "lower_is_better", delta > 0)
        .otherwise(False)
    )


def unfavourable_pct(old: Column, new: Column, polarity: Column, unit: Column) -> Column:
    """Size of an unfavourable move in percent; ratios count in percentage points."""
    d = F.abs(new - old)
    as_points = (F.coalesce(unit, F.lit("")) == "ratio") & (F.abs(old) <= 1.0) & (F.abs(new) <= 1.0)
    return (
        F.when(~unfavourable(new - old, polarity), 0.0)
        .when(as_points, d * 100.0)
        .when(F.abs(old) < 1e-6, F.when(d <= 1.0, d * 100.0).otherwise(d))
        .otherwise(d / F.abs(old) * 100.0)
    )


def risk_band(cri: Column) -> Column:
    return (
        F.when(cri >= 0.70, "CRITICAL").when(cri >= 0.50, "HIGH").when(cri >= 0.30, "MEDIUM").otherwise("LOW")
    )
