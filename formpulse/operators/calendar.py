"""The calendar dimension and its join."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions.dates import month_name


def calendar_dimension(
    spark: SparkSession,
    first_year: int = fv.CALENDAR_FIRST_YEAR,
    last_year: int | None = None,
) -> DataFrame:
    """Twelve rows per year up to the current one, with semester, quarter and bimester labels."""
    last_year = last_year or datetime.date.today().year
    return _labelled(spark.range(first_year * 12, (last_year + 1) * 12, numPartitions=1))


def _labelled(months: DataFrame) -> DataFrame:
    """The calendar's rows from month numbers ``id``, counted from year 0."""
    year = (F.col("id") / 12).cast("int")
    ordinal = (F.col("id") % 12 + 1).cast("int")
    base = months.select(year.alias("ANO"), ordinal.alias("MES_ORDINAL"))
    labels = month_labels(F.col("ANO"), F.col("MES_ORDINAL"))
    return base.select("ANO", labels.pop("MES").alias("MES"), labels.pop("MES_CURTO").alias("MES_CURTO"),
                       "MES_ORDINAL", *(label.alias(name) for name, label in labels.items()))


def month_labels(year: Column, ordinal: Column) -> dict[str, Column]:
    """The labels of a month, by their names in the calendar; null for an unknown year or month."""
    known = F.when(year.isNotNull(), ordinal)

    def part(size: int):
        return F.ceil(known / size).cast("string")

    name, short = (month_name(known, short=s) for s in (False, True))
    year_text = year.cast("string")
    return {
        "MES": name,
        "MES_CURTO": short,
        "SEMESTRE": F.concat(part(6), F.lit(fv.SEMESTER_SUFFIX)),
        "ID_TRIMESTRE": F.concat(year_text, F.lit(".Q"), part(3)),
        "TRIMESTRE": F.concat(part(3), F.lit(fv.QUARTER_SUFFIX)),
        "BIMESTRE": F.concat(part(2), F.lit(fv.BIMESTER_SUFFIX)),
        "PERIODO": F.concat(year_text, F.lit("/"), name),
        "PERIODO_CURTO": F.concat(short, F.lit("/"), year_text),
    }


def calendar_of(*forms: DataFrame, year: str = "ano_consolidacao") -> DataFrame:
    """The calendar of all years in which there are forms, and up to the current one.

    Its bounds are part of the plan: an aggregate of one row, from which the months are generated, so
    that nothing runs before a report does.
    """
    years = [f.select(F.col(year).cast("int").alias("y")) for f in forms]
    this_year = F.year(F.current_date())
    bounds = reduce(DataFrame.unionAll, years).agg(
        F.least(F.min("y"), this_year).alias("first"), F.greatest(F.max("y"), this_year).alias("last"))
    months = F.sequence(F.col("first").cast("long") * 12, F.col("last").cast("long") * 12 + 11)
    return _labelled(bounds.select(F.explode(months).alias("id")))


def join_calendar(
    df: DataFrame, calendar: DataFrame, year: str = "ANO", month: str = "MES"
) -> DataFrame:
    """Left join on year and month name; rows with an unknown month keep a null period.

    A calendar that names a month twice would multiply rows, so its months are made distinct: rows
    that differ in their labels end the run. No broadcast is forced; the calendar's size is known to
    the optimizer or found by adaptive execution.
    """
    rest = [c for c in calendar.columns if c not in ("ANO", "MES")]
    alike = calendar.groupBy("ANO", "MES").agg(
        F.min(F.struct(*rest)).alias("__one"), F.max(F.struct(*rest)).alias("__other"))
    same = F.when(F.col("__one").eqNullSafe(F.col("__other")), F.col("__one")).otherwise(
        F.raise_error(F.concat(F.lit("the calendar has different rows for "), F.col("MES"))))
    calendar = alike.select("ANO", "MES", same.alias("__one")).select("ANO", "MES", "__one.*")
    side = calendar.withColumnsRenamed({"ANO": "__ano", "MES": "__mes"})
    on = (df[year] == side["__ano"]) & (df[month] == side["__mes"])
    return df.join(side, on, "left").drop("__ano", "__mes")
