"""The consolidation of both v1 forms for all periods at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formpulse import fixed_values as fv
from formpulse.operators import attendants, comments, ratings
from formpulse.operators.counters import counted_reports, form_counters
from formpulse.operators.keys import CONSOLIDATION
from formpulse.operators.periods import filter_period, validate_period_args
from formpulse.session import tune
from formpulse.sources.audit import write_audit
from formpulse.sources.bundle import load_survey_bundle
from formpulse.sources.sinks import (
    write_clean_parquet,
    write_period_stats,
    write_report_csv,
)

CSV_REPORTS = ("comentarios", "atendentes")


#: Reports that follow from the counters of a run.
COUNTED = ("medidas", "avaliacoes", "setores", "indicadores")


def monthly_tables(
    general: DataFrame, ambulatory: DataFrame, counters: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Every report of the consolidation as a lazy frame with the period as leading columns.

    ``counters`` are those of :func:`form_counters`; written once, they spare their reports the forms.
    """
    counted = counted_reports(form_counters(general, ambulatory) if counters is None else counters)
    return {
        **{name: counted[name] for name in COUNTED},
        "avaliacoes_por_questao": ratings.rating_by_question(general),
        "avaliacoes_ambulatorio": ratings.rating_by_question(ambulatory, fv.AMBULATORY_QUESTIONS),
        "comentarios": comments.extract_comments(general, ambulatory),
        "comentarios_distintos": comments.extract_comments_distinct(general, ambulatory),
        "atendentes": attendants.attendant_ranking(ambulatory),
        "atendentes_fim_de_ano": attendants.attendant_ratings_trimmed(ambulatory),
    }


def run_monthly(
    spark: SparkSession,
    general_path: str,
    ambulatory_path: str,
    out: str,
    *,
    period: tuple[int, str] | None = None,
    min_year: int | None = fv.GENERAL_MIN_YEAR,
    keep_undated: bool = False,
    general_layout: str | None = "general46",
    ambulatory_layout: str | None = "ambulatory13",
) -> dict[str, str]:
    """Import both exports, keep them as clean parquet, and write every report under ``out``.

    The text is parsed once. One scan of each form gives the counters of a period (``contadores``), from
    which four reports follow; the others scan only their columns. Layouts are those of
    :func:`load_survey_bundle`, None for folders with several. With ``period`` only that
    period is cleaned, reported and replaced; all others stay as earlier runs left them. Malformed
    records are kept in ``rejects``, and every run adds to ``log``. Returns the path of each table.
    """
    tune(spark)
    bundle = load_survey_bundle(
        spark, general_path, ambulatory_path, min_year=min_year, keep_undated=keep_undated,
        general_layout=general_layout, ambulatory_layout=ambulatory_layout)
    wanted = None if period is None else validate_period_args(*period)
    mode = "overwrite" if wanted is None else "periods"
    forms = {}
    for name in ("p1", "p2"):
        path = f"{out}/clean/{name}"
        rows = bundle[name] if wanted is None else filter_period(bundle[name], *wanted)
        write_clean_parquet(rows, path, keys=CONSOLIDATION, mode=mode)
        forms[name] = spark.read.schema(rows.schema).parquet(path)
        if wanted is not None:
            forms[name] = filter_period(forms[name], *wanted)
    paths = {"rejects": f"{out}/rejects", "log": f"{out}/log"}
    bundle["rejects"].write.mode("overwrite").json(paths["rejects"])
    write_audit(bundle["log"], paths["log"])
    paths["contadores"] = f"{out}/contadores"
    counters = form_counters(forms["p1"], forms["p2"])
    write_period_stats(counters, paths["contadores"], keys=CONSOLIDATION, mode=mode)
    counters = spark.read.schema(counters.schema).parquet(paths["contadores"])
    if wanted is not None:
        counters = filter_period(counters, *wanted)
    for name, table in monthly_tables(forms["p1"], forms["p2"], counters).items():
        paths[name] = f"{out}/{name}"
        if name in CSV_REPORTS:
            keys = (*CONSOLIDATION, "kind") if name == "comentarios" else CONSOLIDATION
            write_report_csv(table, paths[name], keys=keys, mode=mode)
        else:
            write_period_stats(table, paths[name], keys=CONSOLIDATION, mode=mode)
    return paths
