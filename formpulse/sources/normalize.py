"""Raw text forms to typed forms: one projection each, no shuffle.

All three accept the raw all-text frame of ``read_survey_csv`` or a stream with that schema, and
pass through extra columns such as ``site``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions import dates, nps, ratings, text
from formpulse.functions.numbers import row_mean


def _extra(df: DataFrame, layout: str) -> list[str]:
    return [c for c in df.columns if c not in fv.LAYOUTS[layout]]


def _nps_column(df: DataFrame):
    score = F.col("nps") if "nps" in df.columns else F.lit(None)
    return score.try_cast("int").alias("nps")


def normalize_general(
    df: DataFrame, *, min_year: int | None = fv.GENERAL_MIN_YEAR, keep_undated: bool = False
) -> DataFrame:
    """Typed general forms with ordinal answers, block means ``m_a``..``m_h`` and ``m_x``.

    ``ano`` and ``mes`` come from the form's date; forms dated before ``min_year`` are left out
    unless it is ``None``, and so are undated ones unless they are kept (their consolidation year
    and month may be known). The old layout's missing columns come out as null.
    """
    # Parsed in a step of its own, since the filter and several columns derive from it.
    df = df.withColumn("data", dates.parse_survey_timestamp(F.col("data")))
    ts = F.col("data")
    optional = ("pesquisa_ativa", "equipe_pesquisa", "quando_queixa", "periodo_queixa")
    typed = df.select(
        *_extra(df, "general46"),
        text.cast_id(F.col("id")).alias("id"),
        ts,
        "nome",
        dates.parse_survey_date(F.col("data_internacao")).alias("data_internacao"),
        dates.parse_survey_date(F.col("data_alta")).alias("data_alta"),
        "contato",
        text.normalize_consent(F.col("autorizo")).alias("autorizo"),
        "setor",
        *(ratings.likert_ordinal(q).alias(q) for q in fv.QUESTIONS),
        *fv.COMMENT_KINDS,
        *_consolidation(),
        *((F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c)
          for c in optional),
        _nps_column(df),
        F.year(ts).alias("ano"),
        F.month(ts).alias("mes"),
    )
    out = typed.withColumns(ratings.block_means()).withColumn("m_x", ratings.mean_of_means())
    if min_year is None:
        return out
    wanted = F.col("ano") >= min_year
    return out.where(wanted | F.col("ano").isNull() if keep_undated else wanted)


def normalize_ambulatory(df: DataFrame) -> DataFrame:
    """Typed ambulatory forms with the mean ``m`` of reception and doctor."""
    df = df.withColumn("data", dates.parse_survey_timestamp(F.col("data")))
    ts = F.col("data")
    typed = df.select(
        *_extra(df, "ambulatory13"),
        text.cast_id(F.col("id")).alias("id"),
        ts,
        "nome",
        "contato",
        *(ratings.likert_ordinal(q).alias(q) for q in fv.AMBULATORY_QUESTIONS),
        *fv.COMMENT_KINDS,
        "atendente",
        *_consolidation(),
        _nps_column(df),
        F.year(ts).alias("ano"),
        F.month(ts).alias("mes"),
    )
    return typed.withColumn("m", row_mean(fv.AMBULATORY_QUESTIONS))


def _consolidation():
    """Consolidation year and month; a month outside the twelve names becomes null."""
    known = dates.month_ordinal(F.col("mes_consolidacao"))
    return (
        F.col("ano_consolidacao").try_cast("int").alias("ano_consolidacao"),
        F.when(known.isNotNull(), F.col("mes_consolidacao")).alias("mes_consolidacao"),
        known.alias("mes_ordinal"),
    )


def clean_manifestations(df: DataFrame, *, null_score: str = "detractor") -> DataFrame:
    """Clean manifestations: the fourteen fixed columns, derived from the ten raw ones.

    The kind of manifestation follows from the texts given and replaces the raw ``tipo``. The
    default ``null_score`` classes a missing score as detractor, but the score stays null.
    """
    texts = [F.col(c) for c in fv.MANIFESTATION_TYPES[:3]]
    # Time and score are parsed in a step of their own, since several columns derive from each.
    df = df.withColumns({
        "data": dates.parse_survey_timestamp(F.col("data")),
        "nps": F.col("nps").try_cast("int"),
    })
    ts, score = F.col("data"), F.col("nps")
    nps_class = nps.nps_class(score, style="v2", null_score=null_score)
    typed = df.select(
        *_extra(df, "manifestation10"),
        *(c.alias(name) for name, c in dates.derive_period(ts).items()),
        ts,
        text.normalize_sector(F.col("setor")).alias("setor"),
        score,
        nps_class.alias("classe"),
        nps.nps_flag(nps_class).alias("flag"),
        text.manifestation_type(*texts).alias("tipo"),
        text.manifestation_text(*texts).alias("manifestacao"),
        text.normalize_name(F.col("nome")).alias("nome"),
        text.normalize_phone(F.col("telefone")).alias("telefone"),
        text.normalize_email(F.col("email")).alias("email"),
    )
    return fill_missing_dash(select_clean_columns(typed))


def select_clean_columns(df: DataFrame) -> DataFrame:
    """The clean manifestation columns in their fixed order, after extra columns if any."""
    return df.select(*(c for c in df.columns if c not in fv.CLEAN_COLUMNS), *fv.CLEAN_COLUMNS)


def fill_missing_dash(df: DataFrame) -> DataFrame:
    """``-`` for missing text; numbers and dates keep their nulls."""
    return df.fillna(fv.MISSING_TEXT, subset=[c for c, kind in df.dtypes if kind == "string"])
