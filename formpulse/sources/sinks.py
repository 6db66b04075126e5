"""Tables and report files.

Partitioned sinks use Spark's rebalance hint: rows of a period meet in few files, and a period that
holds most of the data is still split over many tasks and files.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERIOD_KEYS = ("ano", "mes")

# Spark's CSV writer trims values unless told not to, and escapes quotes by backslash.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


#: The leading folder of tables whose appends carry the id of their run.
RUN = "run_id"


def write_raw_snapshot(
    df: DataFrame, path: str, *, ingest_date: str | None = None, mode: str = "append",
    run_id: str | None = None,
) -> None:
    """Keep the unmodified input as CSV, one folder per ingest date (today if not given).

    With ``run_id`` a repeated call replaces what the run wrote before; see
    :func:`write_clean_parquet`. Without, it adds its rows again.
    """
    day = F.lit(ingest_date).cast("date") if ingest_date else F.current_date()
    dated = df.withColumn("ingest_date", day)
    if run_id is None:
        dated.write.mode(mode).partitionBy("ingest_date").options(**CSV_OPTIONS).csv(path)
    else:
        writer = dated.write.mode("overwrite").partitionBy("ingest_date")
        writer.options(**CSV_OPTIONS).csv(run_folder(path, run_id))


def run_folder(path: str, run_id: str) -> str:
    """Where the rows of one run lie. Ids are letters, digits, dots, dashes and underscores."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run_id):
        raise ValueError(f"not the id of a run: {run_id!r}")
    return f"{path}/{RUN}={run_id}"


def _writer(df: DataFrame, keys: Sequence[str], mode: str):
    """A partitioned writer. ``mode="periods"`` overwrites the periods that ``df`` holds and leaves
    the others as they are."""
    writer = df.hint("rebalance", *keys).write.partitionBy(*keys)
    if mode == "periods":
        return writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    return writer.mode(mode)


def write_clean_parquet(
    df: DataFrame, path: str, *, keys: Sequence[str] = PERIOD_KEYS, mode: str = "append",
    run_id: str | None = None,
) -> None:
    """Write clean rows as parquet in one folder per period, so that reports prune by period.

    The default appends, so a call that is repeated by hand doubles its rows; ``mode="periods"``
    replaces the periods at hand and ``overwrite`` the whole table. With ``run_id`` the rows go to a
    folder of that run, which a repeated call overwrites whole: it appends once, however often it is
    made, also where a repetition has fewer periods. A table has either runs or plain appends.
    """
    if run_id is None:
        _writer(df, keys, mode).parquet(path)
    else:
        _writer(df, keys, "overwrite").parquet(run_folder(path, run_id))


def read_clean_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] = (), *, schema=None
) -> DataFrame:
    """Read clean rows back, in the given column order if any; with a schema also an empty table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path).drop(RUN)
    return df.select(*columns) if columns else df


def write_period_stats(
    df: DataFrame, path: str, *, keys: Sequence[str] = (), mode: str = "periods"
) -> None:
    """Write a statistics table (one row per period and group, so few files).

    With ``keys`` each period has a folder, and a run of one period leaves the others as they are.
    Without, the table is replaced.
    """
    if keys:
        _writer(df, keys, mode).parquet(path)
    else:
        df.write.mode("overwrite" if mode == "periods" else mode).parquet(path)


def decimal_comma(df: DataFrame) -> DataFrame:
    """Fractional numbers as text with a decimal comma; whole values lose their ``.0``."""
    return df.select(
        *(
            F.regexp_replace(
                F.regexp_replace(F.col(name).cast("string"), r"\.0$", ""), "[.]", ","
            ).alias(name)
            if kind in ("double", "float") or kind.startswith("decimal")
            else F.col(name)
            for name, kind in df.dtypes
        )
    )


def write_report_csv(
    df: DataFrame, path: str, *, keys: Sequence[str] = PERIOD_KEYS, mode: str = "periods"
) -> None:
    """Report files with ``;`` between columns and a decimal comma, one folder per period.

    A period without rows gets no folder. By default the periods at hand are replaced and the
    others stay.
    """
    _writer(decimal_comma(df), keys, mode).options(**CSV_OPTIONS, sep=";").csv(path)


def write_comment_workbooks(
    comments: DataFrame,
    path: str,
    *,
    keys: Sequence[str] = PERIOD_KEYS,
    kind_column: str = "kind",
    mode: str = "periods",
) -> None:
    """Comments of each period and kind in their own folder of report files."""
    write_report_csv(comments, path, keys=(*keys, kind_column), mode=mode)
