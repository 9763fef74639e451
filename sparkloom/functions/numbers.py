"""Rounding, shares and guarded ratios as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^n + 0.5) / 10^n: half goes up, in binary floating point."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def ratio(a: Column, b: Column, empty: float = 1.0) -> Column:
    """a / b, or ``empty`` where b is zero."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def noisy_or(parts: Column) -> Column:
    """1 - product(1 - p) of an array of weighted evidence; nulls are no evidence."""
    return round_half_up(1 - F.aggregate(parts, F.lit(1.0), lambda a, p: a * (1 - F.coalesce(p, F.lit(0.0)))), 3)


def severity_weight(severity: Column) -> Column:
    """Fixed weights: error 3, warning 1, info 0.25, candidate 0."""
    return F.when(severity == "error", 3.0).when(severity == "warning", 1.0).when(severity == "info", 0.25).otherwise(0.0)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).when(severity == "info", 2).otherwise(3)


def health_score(weight: Column, files: Column, adoption: Column, coverage: Column) -> Column:
    """0..100 from the weight of findings per file, adoption and coverage."""
    clean = 1 - F.least(F.lit(1.0), ratio(weight, files, 0.0) / 12)
    return F.floor(100 * (0.5 * clean + 0.3 * adoption + 0.2 * coverage) + 0.5).cast("long")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
