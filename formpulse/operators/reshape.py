"""Reshaping, sharing, ranking and binning used by the reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions import text
from formpulse.functions.literals import literal_array
from formpulse.functions.numbers import half_even, share
from formpulse.operators.keys import join_on_keys, with_group_total


def melt(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], *,
    variable: str = "variable", value: str = "value",
) -> DataFrame:
    """Wide to long: one row per id and value column."""
    return df.unpivot(list(ids), list(values), variable, value)


def dcast(
    df: DataFrame, keys: Sequence[str], column: str, values: Mapping[object, str] | Sequence, *,
    weight: Column | None = None,
) -> DataFrame:
    """Long to wide with a fixed set of columns; an absent combination is 0.

    ``values`` lists the values of ``column``, or maps them to output names. Counts rows, or sums
    ``weight``. Conditional sums need one shuffle where a pivot needs two.
    """
    names = values if isinstance(values, Mapping) else {v: str(v) for v in values}
    weight = F.lit(1) if weight is None else weight
    return df.groupBy(*keys).agg(
        *(
            F.coalesce(F.sum(F.when(F.col(column) == v, weight)), F.lit(0)).cast("long").alias(name)
            for v, name in names.items()
        )
    )


def column_totals(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sum of each column, over everything or per key."""
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in columns))


def union_forms(
    general: DataFrame, ambulatory: DataFrame, columns: Sequence[str], *,
    origin: str | None = "origem", prefix_ids: bool = False,
) -> DataFrame:
    """Bag union of both forms, told apart by an origin column and, if asked, an id prefix."""

    def side(df: DataFrame, name: str, prefix: str) -> DataFrame:
        picked = [
            text.prefix_id(F.col(c), prefix).alias(c) if prefix_ids and c == "id" else F.col(c)
            for c in columns
        ]
        return df.select(*picked, *([F.lit(name).alias(origin)] if origin else []))

    return side(general, fv.ORIGIN_GENERAL, fv.ID_PREFIX_GENERAL).unionByName(
        side(ambulatory, fv.ORIGIN_AMBULATORY, fv.ID_PREFIX_AMBULATORY)
    )


def append_or_add_row(
    df: DataFrame, extra: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """Add the values of ``extra`` to the rows with the same keys, or append them as rows."""
    columns = [*keys, value]
    both = df.select(*columns).unionByName(extra.select(*columns))
    return both.groupBy(*keys).agg(F.sum(value).alias(value))


def share_of_total(
    df: DataFrame, value: str, keys: Sequence[str], name: str, *,
    scale: float = 100.0, digits: int | None = None,
) -> DataFrame:
    """``value`` as a share of its sum over the keys, times ``scale``, optionally rounded."""
    out = with_group_total(df, value, keys, "__total")
    ratio = share(F.col(value), F.col("__total")) * F.lit(scale)
    rounded = ratio if digits is None else half_even(ratio, digits)
    return out.withColumn(name, rounded).drop("__total")


def rank_average_ties(
    df: DataFrame, value: str, keys: Sequence[str], name: str = "RANK"
) -> DataFrame:
    """Descending rank of a count within the keys; ties share the mean of their ranks.

    The window runs over the distinct counts of a group, not over its rows: counts that add up to
    ``n`` forms take at most about ``sqrt(2 n)`` distinct values. Ranks are then joined back: the
    rank side has a row per distinct count, and is broadcast while that is small. Where it is not,
    the join is by sort, and adaptive execution splits the rows of a value that many share.
    """
    ties = df.groupBy(*keys, value).agg(F.count("*").alias("__ties"))
    above = (
        Window.partitionBy(*keys)
        .orderBy(F.desc(value))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead = F.coalesce(F.sum("__ties").over(above), F.lit(0))
    ranks = ties.select(*keys, value, (ahead + (F.col("__ties") + 1) / F.lit(2.0)).alias(name))
    return join_on_keys(df, ranks, [*keys, value])


def ordered_domain(x: Column, levels: Sequence[str]) -> Column:
    """1-based position of a value in an ordered list of levels; null where it is not a level."""
    position = F.array_position(literal_array(levels), x).cast("int")
    return F.nullif(position, F.lit(0))


def domain_order(df: DataFrame, column: str, levels: Sequence[str], *first: str) -> DataFrame:
    """Sort by ``first`` and then by the order of the levels rather than by the alphabet."""
    return df.orderBy(*first, ordered_domain(F.col(column), levels))


def equal_width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal-width bins over the value's range.

    Bins are closed on the right, the first one also on the left; empty bins give no row. Missing
    values and NaN are left out. Both bounds are one scalar subquery, so values are never joined or
    sorted.
    """
    if bins < 1:
        raise ValueError(f"bins must be positive: {bins}")
    raw = F.col(value).cast("double")
    numbers = df.select(F.when(~F.isnan(raw), raw).alias("x")).where("x IS NOT NULL")
    bounds = numbers.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high")).alias("b")).scalar()
    binned = numbers.select("x", bounds.alias("b")).select("x", "b.low", "b.high")
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    position = F.when(width > 0, F.ceil((F.col("x") - F.col("low")) / width)).otherwise(F.lit(1))
    binned = binned.select(
        F.least(F.greatest(position.cast("int"), F.lit(1)), F.lit(bins)).alias("bin"),
        "low",
        width.alias("width"),
    )
    return binned.groupBy("bin", "low", "width").agg(F.count("*").alias("n")).select(
        "bin",
        (F.col("low") + (F.col("bin") - 1) * F.col("width")).alias("lower"),
        (F.col("low") + F.col("bin") * F.col("width")).alias("upper"),
        "n",
    )
