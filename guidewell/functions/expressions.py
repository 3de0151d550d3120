"""Column expressions of the statistics; each guards what ANSI mode would raise on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def stripped(token: Column) -> Column:
    """Without white space, Unicode's too, at either end."""
    return F.regexp_replace(token, r"(?U)^\s+|\s+$", "")


def is_missing(value: Column, kind: str = "string") -> Column:
    return value.isNull() | F.isnan(value) if kind in ("double", "float") else value.isNull()


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def mean(sums: Column, n: Column) -> Column:
    return F.when(n > 0, sums / n).otherwise(0.0)


def variance(sums: Column, squares: Column, n: Column, ddof: int = 1) -> Column:
    """From a sum and a sum of squares, never below 0; 0 where there are not more than ``ddof`` values."""
    if ddof < 0:
        raise ValueError("ddof must be >= 0")
    m = mean(sums, n)
    return F.when(n > ddof, F.greatest(squares / n - m * m, F.lit(0.0)) * n / (n - ddof)).otherwise(0.0)


def welch_t(m1: Column, v1: Column, n1: Column, m0: Column, v0: Column, n0: Column) -> Column:
    """Welch's t; without any variance infinite with the difference's sign, or 0."""
    diff, scale = m1 - m0, F.sqrt(v1 / n1 + v0 / n0)
    return F.when(scale > 0, diff / scale).when(diff != 0, F.signum(diff) * F.lit(INFINITY)).otherwise(0.0)


def log2_fold_change(case: Column, control: Column, pseudocount: float = 1.0) -> Column:
    return F.log2((case + pseudocount) / (control + pseudocount))


def histogram_bin(value: Column, bins: int, most: float) -> Column:
    """0 to bins - 1; what is beyond either end falls into the first or last."""
    return F.least(F.greatest(F.floor(value / F.lit(most) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def bounded(raw: Column, scale_factor: float) -> Column:
    """Clipped to [0, scale_factor] and divided by it, in single precision."""
    return (F.least(F.greatest(raw, F.lit(0.0)), F.lit(float(scale_factor))) / F.lit(float(scale_factor))).cast("float")
