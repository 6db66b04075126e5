"""Attendant reports of the ambulatory form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions.text import trim_ws
from formpulse.operators.keys import CONSOLIDATION
from formpulse.operators.periods import complete_cases, filter_month_in
from formpulse.operators.reshape import dcast, rank_average_ties

# Columns in the order the report shows them.
RATING_COLUMNS = {3: "Bom", 4: "Otimo", 2: "Regular", 1: "Ruim"}


def attendant_ratings(
    ambulatory: DataFrame, keys: Sequence[str] = CONSOLIDATION, question: str = "recepcao"
) -> DataFrame:
    """Attendant by rating counts per period; rows without attendant or rating are left out."""
    rated = complete_cases(ambulatory.select(*keys, "atendente", question),
                           ["atendente", question])
    return dcast(rated, [*keys, "atendente"], question, RATING_COLUMNS)


def attendant_ranking(
    ambulatory: DataFrame, keys: Sequence[str] = CONSOLIDATION, question: str = "recepcao"
) -> DataFrame:
    """The crosstab with the number of people asked and its rank, ties sharing their mean rank."""
    ratings = attendant_ratings(ambulatory, keys, question)
    # Added in column order, so that ranks and rows are recognised as the same aggregate and the
    # forms are read and shuffled once.
    asked = F.expr(" + ".join(RATING_COLUMNS.values()))
    return rank_average_ties(ratings.withColumn("QTDE_PESQUISADOS", asked), "QTDE_PESQUISADOS",
                             keys)


def attendant_ratings_trimmed(
    ambulatory: DataFrame, keys: Sequence[str] = CONSOLIDATION, question: str = "recepcao",
    months: Sequence[str] = fv.ATTENDANT_REPORT_MONTHS,
) -> DataFrame:
    """The year-end variant: trimmed names, no blank ones, unrated forms in a column of their own."""
    named = filter_month_in(ambulatory, months).select(
        *keys,
        trim_ws(F.col("atendente")).alias("atendente"),
        F.coalesce(F.when(F.col(question).between(1, 4), F.col(question)), F.lit(0)).alias("r"),
    )
    columns = {1: "Ruim", 2: "Regular", 3: "Bom", 4: "Otimo", 0: "sem_nota"}
    return dcast(named.where(F.col("atendente") != ""), [*keys, "atendente"], "r", columns)
