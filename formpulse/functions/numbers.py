"""Rounding, percentages and means that give the same digits on any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["count_when", "exact_mean", "exact_sum", "half_even", "percent_label", "row_mean", "share"]


def half_even(x: Column, digits: int = 0) -> Column:
    """Round to ``digits`` places, ties to the even digit; never returns a negative zero."""
    scale = 10.0**digits
    rounded = F.rint(x * F.lit(scale)) / F.lit(scale)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double; null where the whole is 0 or null."""
    return F.when(whole != 0, part.cast("double") / whole)


def percent_label(percent: Column, digits: int = 1, *, fixed: bool = False) -> Column:
    """Text such as ``66.7%`` for a number already on the 0..100 scale.

    ``fixed=True`` always shows ``digits`` decimals; otherwise trailing zeros are left out.
    """
    text = F.format_string(f"%.{digits}f", half_even(percent, digits))
    if digits and not fixed:
        text = F.regexp_replace(text, r"\.?0+$", "")
    return F.when(percent.isNotNull(), F.concat(text, F.lit("%")))


def count_when(condition: Column) -> Column:
    """Rows of a group where the condition holds, as a plain conditional count."""
    return F.count(F.when(condition, 1))


def row_mean(names: Sequence[str]) -> Column:
    """Mean of the non-null columns of a row; null where all are null."""
    total = " + ".join(f"coalesce(`{n}`, 0)" for n in names)
    answered = " + ".join(f"if(`{n}` IS NULL, 0, 1)" for n in names)
    return F.expr(
        f"CASE WHEN {answered} > 0 THEN CAST({total} AS DOUBLE) / ({answered}) END"
    )


def exact_sum(x: Column, denominator: int) -> Column:
    """Sum of values that are all multiples of ``1/denominator``, added as whole numbers.

    Plain double sums depend on the order of addition, so a retried task or another partitioning
    can change the last digits. Whole-number sums cannot.
    """
    return F.sum(F.rint(x * F.lit(float(denominator))).cast("long")) / F.lit(float(denominator))


def exact_mean(x: Column, denominator: int) -> Column:
    """Mean of values that are all multiples of ``1/denominator``; see :func:`exact_sum`."""
    units = F.sum(F.rint(x * F.lit(float(denominator))).cast("long"))
    return F.when(F.count(x) > 0, units / (F.count(x) * F.lit(denominator)))
