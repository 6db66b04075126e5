"""Survey dates, Portuguese months and period labels.

Form times are local clock readings without a zone, so they are ``timestamp_ntz``; a streaming
watermark needs a ``timestamp`` and casts at that place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions.literals import literal_array


def parse_survey_timestamp(x: Column) -> Column:
    """``d/M/yyyy H:mm:ss``; anything else is null."""
    return F.try_to_timestamp(x, F.lit(fv.TIMESTAMP_PATTERN)).cast("timestamp_ntz")


def parse_survey_date(x: Column) -> Column:
    """``d/M/yyyy``; anything else is null."""
    return F.try_to_timestamp(x, F.lit(fv.DATE_PATTERN)).cast("date")


def derive_period(ts: Column) -> dict[str, Column]:
    """Day, calendar year and month, and the ``yyyy/MM`` key of a form time."""
    return {
        "dia": ts.cast("date"),
        "ano": F.year(ts),
        "mes": F.month(ts),
        "periodo": F.date_format(ts, fv.PERIOD_KEY_PATTERN),
    }


def _names(short: bool) -> Column:
    return literal_array(fv.MONTHS_SHORT if short else fv.MONTHS)


def month_ordinal(name: Column) -> Column:
    """1..12 from the Portuguese month name; null for any other text."""
    position = F.array_position(_names(short=False), name).cast("int")
    return F.nullif(position, F.lit(0))


def month_name(ordinal: Column, *, short: bool = False) -> Column:
    """Portuguese month name, or its three-letter form, from 1..12."""
    return F.when(ordinal.between(1, 12), F.get(_names(short), ordinal - 1))


def period_from_parts(year: Column, month: Column) -> Column:
    """First day of the month given by a year and a Portuguese month name."""
    ordinal = month_ordinal(month)
    return F.when(ordinal.isNotNull() & year.isNotNull(), F.make_date(year, ordinal, F.lit(1)))


def period_label(first_day: Column) -> Column:
    """``Jan/2019`` from a date."""
    short = month_name(F.month(first_day), short=True)
    return F.concat(short, F.lit("/"), F.year(first_day).cast("string"))
