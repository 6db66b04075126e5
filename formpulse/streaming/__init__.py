"""Incremental ingest and continuously kept statistics."""

from formpulse.streaming.folds import fold_batches, read_batches  # noqa: F401
from formpulse.streaming.ingest import (  # noqa: F401
    compact_ingested,
    read_ingested,
    refresh_if_stale,
    stream_ingest,
)
from formpulse.streaming.reports import (  # noqa: F401
    compact_reports,
    read_report,
    stream_reports,
)
from formpulse.streaming.stats import (  # noqa: F401
    compact_period_stats,
    read_period_stats,
    stream_period_stats,
)
