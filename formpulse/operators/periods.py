"""Period and subset filters. All are plain predicates, so scans prune and push them down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions.text import has_comment
from formpulse.operators.keys import CONSOLIDATION, PERIOD


def validate_period_args(
    year: int, month: str, years: tuple[int, int] | None = None
) -> tuple[int, str]:
    """Return the pair if the month is a Portuguese month name, and the year is in ``years`` if
    given."""
    if years is not None and not years[0] <= int(year) <= years[1]:
        raise ValueError(f"year must be {years[0]}..{years[1]}: {year}")
    if month not in fv.MONTHS:
        raise ValueError(f"month must be one of {', '.join(fv.MONTHS)}: {month}")
    return int(year), month


def filter_period(df: DataFrame, year: int, month: str) -> DataFrame:
    """Forms consolidated in a year and month."""
    return df.where((F.col("ano_consolidacao") == year) & (F.col("mes_consolidacao") == month))


def filter_period_by_date(df: DataFrame, year: int, month: str) -> DataFrame:
    """The older rule: calendar year of the form, month of its consolidation."""
    return df.where((F.col("ano") == year) & (F.col("mes_consolidacao") == month))


def filter_period_key(df: DataFrame, key: str) -> DataFrame:
    """Manifestations of one ``yyyy/MM`` period.

    Year and month are tested too, so that a table partitioned by them reads one folder.
    """
    year, month = (int(part) for part in key.split("/"))
    return df.where(
        (F.col("ano") == year) & (F.col("mes") == month) & (F.col("periodo") == key)
    )


def filter_year(
    df: DataFrame, year: int | None = None, *, min_year: int | None = None,
    column: str = "ano_consolidacao",
) -> DataFrame:
    """One year, or a year and everything after it."""
    if year is not None:
        df = df.where(F.col(column) == year)
    return df if min_year is None else df.where(F.col(column) >= min_year)


def filter_quarter(df: DataFrame, quarter: str) -> DataFrame:
    """Rows of one quarter such as ``2019.Q3``, after the calendar join."""
    return df.where(F.col("ID_TRIMESTRE") == quarter)


def filter_month_in(
    df: DataFrame, months: Sequence[str], column: str = "mes_consolidacao"
) -> DataFrame:
    """Forms of the listed months."""
    return df.where(F.col(column).isin(list(months)))


def months_semi(df: DataFrame, months: DataFrame, on: Sequence[str]) -> DataFrame:
    """Forms whose period is in a table of reference months.

    The table is made distinct first, so its size is bounded by the calendar; whether to broadcast
    it is left to the optimizer, which knows the size.
    """
    return df.join(months.select(*on).distinct(), list(on), "left_semi")


def drop_null_score(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where the score, and every other named column, is present."""
    return df.dropna("any", subset=list(columns) or ["nps"])


def answered_only(df: DataFrame, note: str, score: str) -> DataFrame:
    """Rows with an answer that counts: note present and score above zero."""
    return df.where(F.col(note).isNotNull() & (F.col(score) > 0))


def with_comment(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is more than white space."""
    return df.where(has_comment(F.col(column)))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without any missing value."""
    return df.dropna("any", subset=list(columns) if columns else None)


def filter_by_type(df: DataFrame, kind: str) -> DataFrame:
    """Manifestations of one kind, without the kind column."""
    return df.where(F.col("tipo") == kind).drop("tipo")


def filter_by_sector(df: DataFrame, sector: str) -> DataFrame:
    """Manifestations of one sector, without the sector column."""
    return df.where(F.col("setor") == sector).drop("setor")


def subset_row_counts(df: DataFrame, by: str, keys: Sequence[str] = PERIOD) -> DataFrame:
    """Row count of every listing subset (``by`` kind or sector) of every period."""
    return df.groupBy(*keys, by).agg(F.count("*").alias("n"))


def iterate_periods(df: DataFrame, keys: Sequence[str] = CONSOLIDATION) -> DataFrame:
    """Every period that occurs. Reports group by these keys instead of looping over them."""
    return df.select(*keys).distinct()


def distinct_periods(df: DataFrame, column: str = "periodo") -> DataFrame:
    return df.select(column).distinct()


def distinct_sectors(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sectors that occur, over everything or per period; sort at the point of display."""
    return df.select(*keys, "setor").distinct()


def period_span(df: DataFrame, year: str, month_ordinal: str) -> DataFrame:
    """First and last month and year found in the forms."""
    ordinal = F.col(year) * 12 + F.col(month_ordinal)
    return df.where(ordinal.isNotNull()).agg(
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.min_by(month_ordinal, ordinal).alias("first_month"),
        F.max_by(month_ordinal, ordinal).alias("last_month"),
    )


def quarter_span(calendar: DataFrame) -> DataFrame:
    """First and last period label of every quarter."""
    return calendar.groupBy("ID_TRIMESTRE").agg(
        F.min_by("PERIODO_CURTO", "MES_ORDINAL").alias("first_period"),
        F.max_by("PERIODO_CURTO", "MES_ORDINAL").alias("last_period"),
    )
