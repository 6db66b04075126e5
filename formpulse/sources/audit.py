"""Run log of an import, computed from the data in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formpulse.functions import dates
from formpulse.functions.numbers import count_when

STATUS_OK = "success"
STATUS_ERROR = "error"


def audit_flags(malformed_column: str | None = None) -> dict[str, Column]:
    """What is counted of a raw row, never null: a bad date, a bad score, a bad column count.

    A value counts as bad when text is present but cannot be read.
    """
    return {
        "n_bad_date": F.col("data").isNotNull() & dates.parse_survey_timestamp(F.col("data")).isNull(),
        "n_bad_score": F.col("nps").isNotNull() & F.col("nps").try_cast("int").isNull(),
        "n_malformed": F.col(malformed_column).isNotNull() if malformed_column else F.lit(False),
    }


def audit_status(counts: DataFrame, source: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The log line of counts. The status is ``error`` only where nothing usable arrived: no rows,
    or none with a readable date."""
    status = F.when(F.col("n_rows") > F.col("n_bad_date"), STATUS_OK).otherwise(STATUS_ERROR)
    return counts.select(
        F.lit(source).alias("source"),
        status.alias("status"),
        "n_rows",
        "n_bad_date",
        "n_bad_score",
        "n_malformed",
        *extra,
        F.current_timestamp().alias("ts"),
    )


def ingest_audit(
    raw: DataFrame, source: str, *, malformed_column: str | None = None,
    min_year: int | None = None,
) -> DataFrame:
    """One row: source, status, rows, rows with a bad date, a bad score or a bad column count.

    With ``min_year`` also ``n_undated`` and ``n_before_min_year``: the well-formed rows that a
    year limit leaves out because they have no readable date, or an earlier one.
    """
    flags = audit_flags(malformed_column)
    malformed, ts = flags["n_malformed"], dates.parse_survey_timestamp(F.col("data"))
    left_out = {} if min_year is None else {
        "n_undated": ~malformed & ts.isNull(),
        "n_before_min_year": ~malformed & (F.year(ts) < min_year),
    }
    counts = raw.agg(
        F.count("*").alias("n_rows"),
        *(count_when(c).alias(name) for name, c in (flags | left_out).items()),
    )
    return audit_status(counts, source, tuple(left_out))


def write_audit(audit: DataFrame, path: str, *, mode: str = "append") -> None:
    """Append the run log as JSON lines."""
    audit.write.mode(mode).json(path)
