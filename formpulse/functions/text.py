"""Text rules: trimming, accents, names, contacts, ids and the manifestation precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formpulse import fixed_values as fv


def trim_ws(x: Column) -> Column:
    """Strip blanks, tabs and line breaks from both ends."""
    return F.btrim(x, F.lit(fv.ASCII_BLANKS))


def strip_all(x: Column) -> Column:
    """Strip every Unicode white-space character from both ends."""
    return F.btrim(x, F.lit(fv.UNICODE_BLANKS))


def normalize_sector(x: Column) -> Column:
    return F.upper(strip_all(x))


def normalize_name(x: Column) -> Column:
    """Title case where a capital follows every non-letter, so also after ``'`` and ``-``.

    Names of letters and blanks take the plain function; only others are cut into runs.
    """
    name = strip_all(x)
    runs = F.regexp_extract_all(name, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    cut = F.array_join(F.transform(runs, F.initcap), "")
    return F.when(F.regexp_like(name, F.lit(r"[^\p{L} ]")), cut).otherwise(F.initcap(name))


def normalize_email(x: Column) -> Column:
    return F.lower(strip_all(x))


def normalize_phone(x: Column) -> Column:
    """Digits only."""
    return F.regexp_replace(x, "[^0-9]", "")


def normalize_consent(x: Column) -> Column:
    return F.lower(x)


def cast_id(x: Column) -> Column:
    """Numeric id; text that is not a whole number becomes null. ``12.0``, which exports with blanks
    in a number column give, is 12."""
    whole = F.regexp_replace(x.cast("string"), r"\.0*\s*$", "")
    return whole.try_cast("bigint")


def prefix_id(x: Column, prefix: str) -> Column:
    """Id made unique across forms, such as ``G.17``."""
    return F.concat(F.lit(prefix), x.cast("string"))


def has_comment(x: Column) -> Column:
    """True where the text holds more than white space; null text is not a comment."""
    return F.coalesce(trim_ws(x) != "", F.lit(False))


def manifestation_type(praise: Column, suggestion: Column, complaint: Column) -> Column:
    """Kind of the first text given: praise, then suggestion, then complaint."""
    kinds = fv.MANIFESTATION_TYPES
    return (
        F.when(praise.isNotNull(), kinds[0])
        .when(suggestion.isNotNull(), kinds[1])
        .when(complaint.isNotNull(), kinds[2])
        .otherwise(kinds[3])
    )


def manifestation_text(praise: Column, suggestion: Column, complaint: Column) -> Column:
    return F.coalesce(praise, suggestion, complaint, F.lit(fv.MISSING_TEXT))
