"""Net Promoter Score rules per answer and per score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formpulse import fixed_values as fv

NULL_SCORE_POLICIES = ("drop", "neutral", "detractor")


def _by_class(score: Column, values: tuple, null_score: str) -> Column:
    """One of (detractor, neutral, promoter) values; null scores follow the policy."""
    if null_score not in NULL_SCORE_POLICIES:
        raise ValueError(f"null_score must be one of {NULL_SCORE_POLICIES}: {null_score!r}")
    detractor, neutral, promoter = (F.lit(v) for v in values)
    if_null = {"drop": F.lit(None), "neutral": neutral, "detractor": detractor}[null_score]
    return (
        F.when(score.isNull(), if_null)
        .when(score <= fv.DETRACTOR_MAX, detractor)
        .when(score >= fv.PROMOTER_MIN, promoter)
        .otherwise(neutral)
    )


def nps_class(score: Column, *, style: str = "v2", null_score: str = "drop") -> Column:
    """Class name of a 0..10 score. With ``null_score='drop'`` a null score has no class."""
    labels = {"v1": fv.NPS_CLASSES_V1, "v2": fv.NPS_CLASSES_V2}[style]
    return _by_class(score, labels, null_score)


def nps_sign(score: Column, *, null_score: str = "drop") -> Column:
    """-1, 0 or +1 for detractor, neutral and promoter."""
    return _by_class(score, (-1, 0, 1), null_score)


def nps_flag(nps_class_name: Column) -> Column:
    """Coloured marker of a class name; unknown classes get the detractor's."""
    flags = fv.NPS_FLAGS
    return (
        F.when(nps_class_name == "promotor", flags["promotor"])
        .when(nps_class_name == "neutro", flags["neutro"])
        .otherwise(flags["detrator"])
    )


def nps_zone(score: Column, *, policy: str = "v2") -> Column:
    """Zone of a -100..100 score; null for a null score.

    Policy ``v1`` opens each zone above its edge (50 is still the lower zone), ``v2`` opens it at
    the edge (50 is already the higher zone).
    """
    critical, improve, quality, excellence = {
        "v1": fv.ZONE_LABELS_V1, "v2": fv.ZONE_LABELS_V2,
    }[policy]
    first, second, third = fv.ZONE_EDGES

    def reaches(edge: int) -> Column:
        return score > edge if policy == "v1" else score >= edge

    return (
        F.when(score.isNull(), F.lit(None))
        .when(reaches(third), excellence)
        .when(reaches(second), quality)
        .when(reaches(first), improve)
        .otherwise(critical)
    )


def satisfaction_band(satisfaction: Column) -> Column:
    """Band of a 0..1 composite: at least 0.8, exactly 0, or in between."""
    high, none, low = fv.SATISFACTION_BANDS
    return (
        F.when(satisfaction.isNull(), F.lit(None))
        .when(satisfaction >= 0.8, high)
        .when(satisfaction == 0, none)
        .otherwise(low)
    )
