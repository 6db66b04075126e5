"""Free-text comments of both forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions.text import has_comment, trim_ws
from formpulse.operators.keys import CONSOLIDATION


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per form and comment kind that holds text; the form is read once."""
    texts = F.array(
        *(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("texto"))
          for kind in fv.COMMENT_KINDS)
    )
    return df.select(*columns, F.inline(texts)).where(has_comment(F.col("texto")))


def extract_comments(
    general: DataFrame, ambulatory: DataFrame, keys: Sequence[str] = CONSOLIDATION
) -> DataFrame:
    """Every comment with consent, name and contact, by period and kind; repeats are kept.

    Ambulatory forms do not ask for consent and get a fixed one.
    """
    columns = [*keys, "autorizo", "nome", "contato"]
    consented = ambulatory.withColumn("autorizo", F.lit(fv.AMBULATORY_CONSENT))
    return _long(general, columns).unionByName(_long(consented, columns))


def extract_comments_distinct(
    general: DataFrame, ambulatory: DataFrame, keys: Sequence[str] = CONSOLIDATION
) -> DataFrame:
    """Trimmed comments of both forms, each text once per period and kind.

    Copies of a text collapse within each task before the shuffle, so a text that makes up much of
    the data travels once per task.
    """
    both = _long(general, keys).unionByName(_long(ambulatory, keys))
    return both.withColumn("texto", trim_ws(F.col("texto"))).distinct()
