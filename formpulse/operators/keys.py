"""Group keys and the two patterns that several reports share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONSOLIDATION = ("ano_consolidacao", "mes_consolidacao")
PERIOD = ("periodo",)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that keeps groups with a missing key; right columns follow the left ones.

    No broadcast is forced: adaptive execution broadcasts the right side if it is small when its
    size is known, and joins by sort, splitting skewed keys, if it is not.
    """
    renamed = right.select(*(F.col(c).alias(f"__{c}") if c in keys else F.col(c)
                             for c in right.columns))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return left.join(renamed, same, "left").drop(*(f"__{k}" for k in keys))


def with_group_total(
    df: DataFrame, value: str, keys: Sequence[str], name: str
) -> DataFrame:
    """Attach the sum of ``value`` over the keys to every row.

    The totals are a second small aggregate joined back, not a window, because a window would pull
    all rows of a group into one task.
    """
    totals = df.groupBy(*keys).agg(F.sum(value).alias(name))
    return join_on_keys(df, totals, keys)
