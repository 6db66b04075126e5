"""Net Promoter Score reports. Each is one scan and counts per class, grouped by all periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions import dates, nps
from formpulse.functions.numbers import count_when, half_even, percent_label, share
from formpulse.operators.calendar import join_calendar, month_labels
from formpulse.operators.keys import CONSOLIDATION, PERIOD
from formpulse.operators.periods import drop_null_score, filter_month_in, filter_year
from formpulse.operators.reshape import dcast, union_forms

CLASS_COUNTS = ("DETRATORES", "NEUTRO", "PROMOTORES")
#: Counts of a summary by the sign of a score.
SIGNS = {-1: "detratores", 0: "neutros", 1: "promotores"}


def nps_summary(
    df: DataFrame, keys: Sequence[str] = PERIOD, *, null_score: str = "drop",
) -> DataFrame:
    """Counts and shares per class, score and zone, one row per group.

    The score is the rounded difference of the shares; a group without any score has a null score
    and a null zone.
    """
    sign = nps.nps_sign(F.col("nps"), null_score=null_score)
    return summary_of_counts(df.groupBy(*keys).agg(
        *(count_when(sign == value).alias(name) for value, name in SIGNS.items())), keys)


def summary_of_counts(counts: DataFrame, keys: Sequence[str] = PERIOD) -> DataFrame:
    """Shares, score and zone of groups whose classes are counted already."""
    names = tuple(SIGNS.values())
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    shares = {n: share(F.col(n), F.col("total")) for n in names}
    score = half_even((shares["promotores"] - shares["detratores"]) * 100, 2)
    return counts.withColumn("total", total).select(
        *keys,
        *(c for n in names for c in (
            F.col(n), percent_label(shares[n] * 100, 2, fixed=True).alias(f"p_{n}"))),
        "total",
        score.alias("score"),
        nps.nps_zone(score, policy="v2").alias("zona"),
    )


def _balance(n_forms: Column, score: Column) -> Column:
    return percent_label(share(score, n_forms) * 100, 1)


def nps_by_month(df: DataFrame, keys: Sequence[str] = CONSOLIDATION) -> DataFrame:
    """Forms with a score, sum of the signs and its share as text, per month of one form."""
    counts = drop_null_score(df, "nps").groupBy(*keys).agg(
        F.count("*").alias("QTDE_FORM"),
        F.sum(nps.nps_sign(F.col("nps"))).alias("NPS_SCORE"),
    )
    return counts.withColumn("PROP", _balance(F.col("QTDE_FORM"), F.col("NPS_SCORE")))


def nps_rows(
    general: DataFrame, ambulatory: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Both forms' scored answers with origin, class and sign, after ``keys`` such as ``site``."""
    columns = [*keys, *CONSOLIDATION, "id", "nps"]
    both = union_forms(drop_null_score(general), drop_null_score(ambulatory), columns,
                       origin="ORIGEM")
    return both.select(
        *keys,
        F.col("ano_consolidacao").alias("ANO"),
        F.col("mes_consolidacao").alias("MES"),
        "ORIGEM",
        F.col("id").alias("ID"),
        F.col("nps").alias("NOTA"),
        nps.nps_class(F.col("nps"), style="v1").alias("CLASSE"),
        nps.nps_sign(F.col("nps")).alias("NPS"),
    )


def _monthly_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per year and month, so that the calendar joins a few hundred rows, not the forms."""
    classes = zip(CLASS_COUNTS, fv.NPS_CLASSES_V1, strict=True)
    return rows.groupBy(*keys, "ANO", "MES").agg(
        F.count("*").alias("TOTAL"),
        count_when(F.col("ORIGEM") == fv.ORIGIN_GENERAL).alias("QTDE_GERAL"),
        count_when(F.col("ORIGEM") == fv.ORIGIN_AMBULATORY).alias("QTDE_AMBULATORIO"),
        *(count_when(F.col("CLASSE") == label).alias(name) for name, label in classes),
    )


def _on_calendar(rows: DataFrame, calendar: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Monthly counts with the calendar's labels. Without a calendar every month of every year has
    them, worked out from its own year and name, so that no calendar need be made or joined."""
    counts = _monthly_counts(rows, keys)
    if calendar is not None:
        return join_calendar(counts, calendar)
    labels = month_labels(F.col("ANO"), dates.month_ordinal(F.col("MES")))
    return counts.withColumns({name: labels[name] for name in ("ID_TRIMESTRE", "PERIODO_CURTO")})


def nps_by_period_origin(
    rows: DataFrame, calendar: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Forms per period and origin with the sum of signs; unmatched months share a null period."""
    joined = _on_calendar(rows, calendar, keys)
    counts = joined.groupBy(*keys, "PERIODO_CURTO").agg(
        F.sum("TOTAL").alias("QTDE_FORM"),
        F.sum("QTDE_GERAL").alias("QTDE_GERAL"),
        F.sum("QTDE_AMBULATORIO").alias("QTDE_AMBULATORIO"),
        F.sum(F.col("PROMOTORES") - F.col("DETRATORES")).alias("NPS_SCORE"),
    )
    return counts.withColumn("PROP", _balance(F.col("QTDE_FORM"), F.col("NPS_SCORE")))


def nps_composition(
    rows: DataFrame, calendar: DataFrame | None = None, quarter: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Class counts and whole percents per calendar period, of one quarter or of all.

    The score is the difference of the rounded percents, so it can differ by a point from
    :func:`nps_summary`.
    """
    joined = _on_calendar(rows, calendar, keys)
    wanted = F.col("ID_TRIMESTRE").isNotNull() if quarter is None else (
        F.col("ID_TRIMESTRE") == quarter)
    sums = joined.where(wanted).groupBy(*keys, "ID_TRIMESTRE", "PERIODO_CURTO").agg(
        *(F.sum(c).alias(c) for c in (*CLASS_COUNTS, "TOTAL"))
    )
    percents = sums.select(
        *keys,
        "ID_TRIMESTRE",
        F.col("PERIODO_CURTO").alias("PERIODO"),
        *CLASS_COUNTS,
        "TOTAL",
        *(half_even(F.col(c) * 100 / F.col("TOTAL")).alias(f"P_{c}") for c in CLASS_COUNTS),
    )
    score = F.col("P_PROMOTORES") - F.col("P_DETRATORES")
    return percents.withColumn("NPS", score).withColumn(
        "ZONA", nps.nps_zone(F.col("NPS"), policy="v1")
    )


def nps_quarter_total(
    rows: DataFrame, calendar: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Scored forms per quarter."""
    joined = _on_calendar(rows, calendar, keys)
    return joined.where(F.col("ID_TRIMESTRE").isNotNull()).groupBy(*keys, "ID_TRIMESTRE").agg(
        F.sum("TOTAL").alias("TOTAL")
    )


def compared_rows(
    general: DataFrame, ambulatory: DataFrame, year: int,
    months: Sequence[str] = fv.REFERENCE_MONTHS, keys: Sequence[str] = (),
) -> DataFrame:
    """Scored answers of both forms in chosen months of a year, with prefixed ids."""

    def chosen(df: DataFrame) -> DataFrame:
        return filter_month_in(filter_year(drop_null_score(df), year), months)

    both = union_forms(chosen(general), chosen(ambulatory), [*keys, *CONSOLIDATION, "id", "nps"],
                       origin=None, prefix_ids=True)
    period = F.concat(F.col("ano_consolidacao").cast("string"), F.lit("/"), "mes_consolidacao")
    return both.select(
        *keys,
        period.alias("PERIODO"),
        dates.month_ordinal(F.col("mes_consolidacao")).alias("MES_ORDINAL"),
        F.col("id").alias("ID"),
        F.col("nps").alias("NOTA"),
        nps.nps_class(F.col("nps"), style="v1").alias("CLASSE"),
        nps.nps_sign(F.col("nps")).alias("NPS"),
    )


def nps_compare_forms(
    general: DataFrame, ambulatory: DataFrame, year: int,
    months: Sequence[str] = fv.REFERENCE_MONTHS, keys: Sequence[str] = (),
) -> DataFrame:
    """Class counts per chosen month, both forms together."""
    rows = compared_rows(general, ambulatory, year, months, keys)
    return dcast(rows, [*keys, "PERIODO", "MES_ORDINAL"], "CLASSE",
                 dict(zip(fv.NPS_CLASSES_V1, CLASS_COUNTS, strict=True)))


def nps_crosstab(rows: DataFrame, keys: Sequence[str] = ("PERIODO",)) -> DataFrame:
    """Period by class contingency table of classified rows."""
    return dcast(rows, keys, "CLASSE", fv.NPS_CLASSES_V1)
