"""Anomalies of a column, from its statistics, the shapes of its values and its numbers."""

from __future__ import annotations

import math
import re

from ..model import ODD, Notice

# Thresholds, and names that promise unique values.
HIGH_NULLS, ALMOST_ALL = 50.0, 90.0
SIGNIFICANT = 0.05
LEAST_NUMBERS, FENCE, MANY_PCT = 8, 1.5, 1.0
KEY = re.compile(r"(id|.*_id|pk|primary_key|uuid|guid)", re.IGNORECASE)


def odd(kind: str, level: str, words: str) -> Notice:
    return Notice(ODD, kind, level=level, words=words)


def high_nulls(null_pct: float, threshold: float = HIGH_NULLS) -> Notice | None:
    if null_pct < threshold:
        return None
    return odd("high_nulls", "high" if null_pct >= ALMOST_ALL else "warn", f"{null_pct:.2f}% of values are NULL (>= {threshold:.0f}%).")


def mixed_types(dtype: str, shapes: dict[str, int]) -> Notice | None:
    """``shapes``: how many values have each shape; empty ones are left out."""
    total = sum(shapes.values())
    if not total or not re.search("VARCHAR|TEXT", dtype.upper()):
        return None
    common = sorted(((s, n) for s, n in shapes.items() if n / total >= SIGNIFICANT), key=lambda x: -x[1])
    if len(common) < 2:  # one shape, or one besides a few stray values
        return None
    said = ", ".join(f"{s}={n}" for s, n in common)
    return odd("mixed_types", "warn", f"VARCHAR column carries mixed value shapes ({said}).")


def key_duplicates(name: str, rows: int, distinct: int) -> Notice | None:
    """A null counts as a duplicate: it is a row without a value of its own."""
    if rows <= 1 or distinct >= rows or not KEY.fullmatch(name):
        return None
    return odd("pk_duplicates", "high", f"PK-candidate column has {rows - distinct:,} duplicate value(s) ({distinct:,}/{rows:,} distinct).")


def fences(numbers: list[float]) -> tuple[float, float] | None:
    """What lies outside is an outlier: the quartiles (interpolated) and 1.5 times their distance; None if they are equal."""
    ordered, last = sorted(numbers), len(numbers) - 1

    def quartile(q: float) -> float:
        below = int(last * q)
        part = last * q - below
        return ordered[below] * (1 - part) + ordered[min(below + 1, last)] * part

    low, high = quartile(0.25), quartile(0.75)
    reach = FENCE * (high - low)
    return (low - reach, high + reach) if reach > 0 else None


def rounded(x: float, places: int) -> float:
    """``x`` to so many decimal places as SQL engines round: scaled, halves away from zero; as it is where that overflows."""
    scaled = x * 10.0**places
    if not math.isfinite(scaled):
        return x
    whole = math.trunc(scaled)
    return float(whole + (math.copysign(1, scaled) if abs(scaled - whole) >= 0.5 else 0)) / 10.0**places


def numeric_outliers(numbers: list[float]) -> Notice | None:
    n = len(numbers)
    if n < LEAST_NUMBERS or not (fence := fences(numbers)):
        return None
    outside = sum(not fence[0] <= x <= fence[1] for x in numbers)
    if not outside:
        return None
    pct = 100.0 * outside / n
    return odd("numeric_outliers", "warn" if pct >= MANY_PCT else "info", f"{outside} of {n} values lie outside IQR fence [{fence[0]:.4g}, {fence[1]:.4g}] ({pct:.1f}%).")


def anomalies(name: str, dtype: str, rows: int, distinct: int, null_pct: float, shapes: dict[str, int], numbers: list[float] | None, threshold: float = HIGH_NULLS) -> list[Notice]:
    found = [high_nulls(null_pct, threshold), mixed_types(dtype, shapes), key_duplicates(name, rows, distinct), numeric_outliers(numbers) if numbers else None]
    return [a for a in found if a]
