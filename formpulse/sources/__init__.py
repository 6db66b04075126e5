"""Readers, normalisation of the three form families, and sinks."""

from formpulse.sources.audit import ingest_audit, write_audit  # noqa: F401
from formpulse.sources.bundle import load_survey_bundle, survey_bundle  # noqa: F401
from formpulse.sources.csv import (  # noqa: F401
    layout_schema,
    read_mixed_csv,
    read_survey_csv,
    rename_positional,
)
from formpulse.sources.normalize import (  # noqa: F401
    clean_manifestations,
    fill_missing_dash,
    normalize_ambulatory,
    normalize_general,
    select_clean_columns,
)
from formpulse.sources.sinks import (  # noqa: F401
    decimal_comma,
    read_clean_parquet,
    write_clean_parquet,
    write_comment_workbooks,
    write_period_stats,
    write_raw_snapshot,
    write_report_csv,
)
