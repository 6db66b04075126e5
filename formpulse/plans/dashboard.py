"""The tables behind the manifestation dashboard."""

from __future__ import annotations

from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from formpulse import fixed_values as fv
from formpulse.operators import manifestations as mf
from formpulse.operators import nps, periods
from formpulse.session import tune
from formpulse.sources.csv import layout_schema
from formpulse.sources.normalize import clean_manifestations
from formpulse.streaming.ingest import read_ingested, refresh_if_stale


def dashboard_tables(
    clean: DataFrame, period: str | None = None, *, null_score: str = "detractor"
) -> dict[str, DataFrame]:
    """Every table of the dashboard, for all periods or, pruned at the scan, for one.

    ``null_score`` says what a missing score counts as; give the policy the rows were cleaned with.
    """
    rows = clean if period is None else periods.filter_period_key(clean, period)
    pivot = mf.period_sector_pivot(rows)
    return {
        "periodos": periods.distinct_periods(clean),
        "setores": periods.distinct_sectors(rows, ["periodo"]),
        "estatisticas": mf.sector_share(pivot),
        "totais": mf.headline_totals(pivot),
        "por_dia": mf.daily_counts(rows),
        "por_setor": mf.sector_counts(rows),
        "nps": nps.nps_summary(rows, null_score=null_score),
        "manifestacoes": mf.drop_display_columns(rows),
        "registros_por_tipo": periods.subset_row_counts(rows, "tipo"),
        "registros_por_setor": periods.subset_row_counts(rows, "setor"),
    }


def read_dashboard_table(spark: SparkSession, path: str) -> DataFrame:
    """The clean table, without rows where no export was taken in yet."""
    empty = clean_manifestations(spark.createDataFrame([], layout_schema("manifestation10")))
    try:
        return read_ingested(spark, path, columns=fv.CLEAN_COLUMNS, schema=empty.schema)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty


def refresh_dashboard(
    spark: SparkSession, drop_folder: str, out: str, period: str | None = None, *,
    null_score: str = "detractor", max_age: float = -1, **read_options,
) -> dict[str, DataFrame]:
    """Take in the exports that arrived since the last run, then give the tables.

    With ``max_age`` a table that is no older, in seconds, is given as it is. Rejects and the run
    log lie next to the clean table. A first run without exports gives empty tables.
    """
    tune(spark)
    clean = partial(clean_manifestations, null_score=null_score)
    refresh_if_stale(spark, drop_folder, f"{out}/clean", f"{out}/progress", max_age=max_age, clean=clean,
                     **read_options)
    return dashboard_tables(
        read_dashboard_table(spark, f"{out}/clean"), period, null_score=null_score)
