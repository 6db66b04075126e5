"""Constant tables as one literal expression each, which Catalyst folds to a constant."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(value: str | int) -> str:
    if isinstance(value, int):
        return str(value)
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def array_sql(values: Sequence[str | int]) -> str:
    return f"array({', '.join(map(sql_literal, values))})"


def map_sql(table: Mapping[str, int]) -> str:
    pairs = (f"{sql_literal(k)}, {sql_literal(v)}" for k, v in table.items())
    return f"map({', '.join(pairs)})"


def literal_array(values: Sequence[str | int]) -> Column:
    return F.expr(array_sql(values))
