"""The NPS run over both forms."""

from __future__ import annotations

from pyspark.sql import DataFrame

from formpulse.operators import nps
from formpulse.operators.calendar import calendar_of, join_calendar


def nps_tables(
    general: DataFrame, ambulatory: DataFrame, calendar: DataFrame | None = None,
    quarter: str | None = None,
) -> dict[str, DataFrame]:
    """Row-level and consolidated NPS frames, and the composition of one quarter or of all.

    Without a calendar the rows get the one that covers the forms, made in their own plan, and the counts
    work out their labels; nothing runs before a table is used.
    """
    rows = nps.nps_rows(general, ambulatory)
    covering = calendar_of(general, ambulatory) if calendar is None else calendar
    return {
        "df": join_calendar(rows, covering),
        "consolidado": nps.nps_by_period_origin(rows, calendar),
        "composicao": nps.nps_composition(rows, calendar, quarter),
        "total_por_trimestre": nps.nps_quarter_total(rows, calendar),
        "por_mes_geral": nps.nps_by_month(general),
        "por_mes_ambulatorio": nps.nps_by_month(ambulatory),
    }
