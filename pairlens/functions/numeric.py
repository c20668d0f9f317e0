"""Floating-point column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_if_finite(names: Sequence[str]) -> str:
    """SQL text: 0 if every named column is finite, NaN if one is NaN or infinite, NULL if NULL.

    One expression however many columns there are. Finiteness must not be tested
    by range comparisons: Parquet statistics ignore NaN and prune it.
    """
    return "(" + " + ".join(f"`{name}` * 0.0D" for name in names) + ")"


def all_finite(names: Sequence[str]) -> str:
    """SQL text: no named column is NULL, NaN or infinite."""
    return f"({zero_if_finite(names)} <=> 0.0D)"


def not_finite(value: Column) -> Column:
    """NULL, NaN or infinite."""
    return ~(value * 0.0).eqNullSafe(F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Product-moment correlation aggregate, NULL when either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def general_format(value: Column, digits: int = 12) -> Column:
    """Shortest ``%.<digits>g`` text: significant digits without trailing zeros."""
    text = F.format_string(f"%.{digits}g", value)
    text = F.regexp_replace(text, r"(\.[0-9]*?)0+(e|$)", "$1$2")
    return F.regexp_replace(text, r"\.(e|$)", "$1")


def order_free_sum(weight: str, value: str) -> str:
    """SQL sum of ``weight`` times a double, the same in whatever order rows arrive.

    Doubles are summed as whole numbers: the integer part and two 26-bit parts of the
    fraction, each cut off exactly. Parts below 2**26 fit a BIGINT sum for 2**37 rows;
    a sum that does not fit is an error in ANSI mode, never a wrapped value.
    """
    step = "CAST(67108864 AS DOUBLE)"
    fraction = f"({value} - floor({value}))"
    middle = f"floor({fraction} * {step})"
    parts = (f"floor({value})", middle, f"floor(({fraction} * {step} - {middle}) * {step})")
    sums = [f"CAST(sum({weight} * CAST({part} AS BIGINT)) AS DOUBLE)" for part in parts]
    return f"({sums[0]} + {sums[1]} / {step} + {sums[2]} / {step} / {step})"
