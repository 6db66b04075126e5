"""Both v1 forms and their means projections as lazy frames."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.sources.audit import ingest_audit
from formpulse.sources.csv import MALFORMED, read_mixed_csv, read_survey_csv, split_malformed
from formpulse.sources.normalize import normalize_ambulatory, normalize_general

BLOCK_MEAN_COLUMNS = (*(f"m_{b}" for b in fv.BLOCK_SIZES), "m_x")


def means_projection(df: DataFrame, *, by_date: bool = False) -> DataFrame:
    """Period and means of a normalised form, general or ambulatory by its columns.

    The period is the consolidation year and month name, or with ``by_date`` the calendar year and
    month of the form's date (the older rule).
    """
    values = BLOCK_MEAN_COLUMNS if "m_x" in df.columns else (*fv.AMBULATORY_QUESTIONS, "m")
    if by_date:
        return df.select("ano", "mes", *values)
    return df.select(
        F.col("ano_consolidacao").alias("ano"), F.col("mes_consolidacao").alias("mes"), *values
    )


def survey_bundle(
    raw_general: DataFrame,
    raw_ambulatory: DataFrame,
    *,
    min_year: int | None = fv.GENERAL_MIN_YEAR,
    keep_undated: bool = False,
) -> dict[str, DataFrame]:
    """``p1``, ``p1_medias``, ``p2`` and ``p2_medias`` from the two raw frames."""
    general = normalize_general(raw_general, min_year=min_year, keep_undated=keep_undated)
    ambulatory = normalize_ambulatory(raw_ambulatory)
    return {
        "p1": general,
        "p1_medias": means_projection(general),
        "p2": ambulatory,
        "p2_medias": means_projection(ambulatory),
    }


def load_survey_bundle(
    spark: SparkSession,
    general_path: str,
    ambulatory_path: str,
    *,
    general_layout: str | None = "general46",
    ambulatory_layout: str | None = "ambulatory13",
    null_tokens: str = "na_only",
    min_year: int | None = fv.GENERAL_MIN_YEAR,
    keep_undated: bool = False,
) -> dict[str, DataFrame]:
    """Read and normalise both forms; nothing runs until a frame is used.

    Records with another number of columns are in ``rejects`` (form, first column, record), and
    ``log`` counts both forms' rows, rejects and what the year limit leaves out. A layout of None takes
    that of each file's own header, for folders that hold older and newer exports.
    """
    raws = {
        "general": (general_path, general_layout),
        "ambulatory": (ambulatory_path, ambulatory_layout),
    }
    good, rejects, log = {}, None, None
    for form, (path, layout) in raws.items():
        read = partial(read_mixed_csv, prefix=form) if layout is None else partial(read_survey_csv, layout=layout)
        raw = read(spark, path, null_tokens=null_tokens, malformed_column=MALFORMED)
        good[form], bad = split_malformed(raw)
        bad = bad.select(F.lit(form).alias("formulario"), "*")
        counted = ingest_audit(
            raw, form, malformed_column=MALFORMED,
            min_year=min_year if form == "general" and min_year is not None else 0)
        rejects = bad if rejects is None else rejects.unionByName(bad)
        log = counted if log is None else log.unionByName(counted)
    frames = survey_bundle(
        good["general"], good["ambulatory"], min_year=min_year, keep_undated=keep_undated)
    return {**frames, "rejects": rejects, "log": log}


def form_row_counts(general: DataFrame, ambulatory: DataFrame) -> DataFrame:
    """Rows of each form."""
    forms = general.select(F.lit("p1").alias("form")).union(
        ambulatory.select(F.lit("p2").alias("form")))
    return forms.groupBy("form").agg(F.count("*").alias("n"))
