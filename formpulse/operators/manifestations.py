"""Statistics and listings of clean manifestations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions.numbers import half_even, percent_label, share
from formpulse.operators.keys import PERIOD, join_on_keys, with_group_total

TYPE_COLUMNS = {kind: kind.replace(" ", "_") for kind in fv.MANIFESTATION_TYPES}


def period_type_sector_counts(df: DataFrame, keys: Sequence[str] = PERIOD) -> DataFrame:
    """Dated manifestations per period, kind and sector."""
    return df.groupBy(*keys, "tipo", "setor").agg(F.count("data").alias("n"))


def period_sector_pivot(df: DataFrame, keys: Sequence[str] = PERIOD) -> DataFrame:
    """Kinds as columns per period and sector, with their total; absent kinds are 0.

    The kinds are a fixed list, so each is a conditional count and the report needs one shuffle.
    """
    counts = df.groupBy(*keys, "setor").agg(
        *(F.count(F.when(F.col("tipo") == kind, F.col("data"))).alias(name)
          for kind, name in TYPE_COLUMNS.items())
    )
    names = list(TYPE_COLUMNS.values())
    return counts.withColumn("total", sum((F.col(n) for n in names[1:]), F.col(names[0])))


def period_totals(pivot: DataFrame, keys: Sequence[str] = PERIOD) -> DataFrame:
    """Manifestations per period."""
    return pivot.groupBy(*keys).agg(F.sum("total").alias("n_periodo"))


def attach_period_total(
    pivot: DataFrame, totals: DataFrame | None = None, keys: Sequence[str] = PERIOD
) -> DataFrame:
    """The pivot with its period's total on every row."""
    if totals is None:
        return with_group_total(pivot, "total", keys, "n_periodo")
    return join_on_keys(pivot, totals, keys)


def sector_share(pivot: DataFrame, keys: Sequence[str] = PERIOD) -> DataFrame:
    """The pivot with period total and each sector's share of it, to four places."""
    whole = attach_period_total(pivot, keys=keys)
    ratio = half_even(share(F.col("total"), F.col("n_periodo")), 4)
    return whole.withColumn("proporcao", ratio)


def headline_totals(pivot: DataFrame, keys: Sequence[str] = PERIOD) -> DataFrame:
    """Total and totals per kind of each period."""
    return pivot.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in ("total", *TYPE_COLUMNS.values()))
    )


def sector_headline(pivot: DataFrame, keys: Sequence[str] = PERIOD) -> DataFrame:
    """Total per sector of each period."""
    return pivot.select(*keys, "setor", "total")


def daily_counts(df: DataFrame, keys: Sequence[str] = PERIOD) -> DataFrame:
    """Manifestations per day of each period."""
    return df.groupBy(*keys, "dia").agg(F.count("dia").alias("n"))


def sector_counts(df: DataFrame, keys: Sequence[str] = PERIOD) -> DataFrame:
    """Manifestations per sector of each period."""
    return df.groupBy(*keys, "setor").agg(F.count("setor").alias("n"))


def drop_display_columns(df: DataFrame) -> DataFrame:
    """A listing without its period columns and with the time as text."""
    shown = df.withColumn("data", F.date_format("data", fv.DISPLAY_TIMESTAMP_PATTERN))
    return shown.drop(*fv.HIDDEN_COLUMNS)


def rename_display(stats: DataFrame) -> DataFrame:
    """Period statistics under display headings, with the share as percent text. The period stays, as
    rows of several periods may be shown."""
    shown = stats.drop("n_periodo").withColumn(
        "proporcao", percent_label(F.col("proporcao") * 100, 2, fixed=True)
    )
    return shown.withColumnsRenamed(fv.DISPLAY_HEADINGS)


def sort_latest_first(df: DataFrame) -> DataFrame:
    """Listing order, newest first; for the point of display, after :func:`periods.filter_period_key`."""
    return df.orderBy(F.desc("data"))


def sort_period_sector(stats: DataFrame) -> DataFrame:
    return stats.orderBy("periodo", "setor")


def sort_by_count(counts: DataFrame, value: str, *keys: str) -> DataFrame:
    """Largest first, within the leading keys if given."""
    return counts.orderBy(*keys, F.desc(value))


def sort_by_rank(ranking: DataFrame, *keys: str) -> DataFrame:
    return ranking.orderBy(*keys, "RANK")
