"""Report tables of manifestations kept current batch by batch.

A batch adds counters of its own rows, and then only the periods it touches are reported anew: their
counters are read from all batches, summed up, and the periods' folders of each report replaced. The
other periods are neither read nor written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from formpulse.functions.nps import nps_sign
from formpulse.operators import manifestations as mf
from formpulse.operators.nps import SIGNS, summary_of_counts
from formpulse.sources.normalize import clean_manifestations
from formpulse.sources.sinks import PERIOD_KEYS, write_period_stats
from formpulse.streaming.folds import BATCH, fold_batches, read_batches
from formpulse.streaming.ingest import last_batch, stream_ingest

#: What rows are counted by, after the folders' year and month.
COUNTED_BY = ("periodo", "dia", "setor", "tipo", "nps")
KEYS = (*PERIOD_KEYS, "periodo")


def count_rows(rows: DataFrame) -> DataFrame:
    """Counters of clean manifestations: rows (n) and dated rows (n_data) by period, day, sector, kind
    and score. Counters of several batches add up."""
    return rows.groupBy(*PERIOD_KEYS, *COUNTED_BY).agg(F.count("*").alias("n"), F.count("data").alias("n_data"))


def merge_counters(counters: DataFrame) -> DataFrame:
    return counters.groupBy(*PERIOD_KEYS, *COUNTED_BY).agg(F.sum("n").alias("n"), F.sum("n_data").alias("n_data"))


def report_tables(
    counters: DataFrame, *, keys: Sequence[str] = KEYS, null_score: str = "detractor"
) -> dict[str, DataFrame]:
    """The counted tables of the dashboard from counters instead of rows."""

    def total(condition: Column, count: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(count))), F.lit(0))

    kinds = counters.groupBy(*keys, "setor").agg(
        *(total(F.col("tipo") == kind, "n_data").alias(name) for kind, name in mf.TYPE_COLUMNS.items()))
    names = list(mf.TYPE_COLUMNS.values())
    pivot = kinds.withColumn("total", sum((F.col(n) for n in names[1:]), F.col(names[0])))
    sign = nps_sign(F.col("nps"), null_score=null_score)
    classes = counters.groupBy(*keys).agg(*(total(sign == value).alias(name) for value, name in SIGNS.items()))
    return {
        "estatisticas": mf.sector_share(pivot, keys),
        "totais": mf.headline_totals(pivot, keys),
        "por_dia": counters.groupBy(*keys, "dia").agg(total(F.col("dia").isNotNull()).alias("n")),
        "por_setor": counters.groupBy(*keys, "setor").agg(total(F.col("setor").isNotNull()).alias("n")),
        "nps": summary_of_counts(classes, keys),
    }


def in_periods(periods: Sequence[tuple[int | None, int | None]]) -> Column:
    """Rows of the listed years and months, as a filter that prunes folders."""
    return reduce(or_, (
        F.col("ano").eqNullSafe(F.lit(ano)) & F.col("mes").eqNullSafe(F.lit(mes)) for ano, mes in periods
    ), F.lit(False))


def refresh_reports(
    spark: SparkSession, out: str, periods: Sequence[tuple[int | None, int | None]], *,
    last: int | None = None, null_score: str = "detractor",
) -> None:
    """Report the listed periods anew from the counters of all batches up to ``last``."""
    counters = read_batches(spark, f"{out}/counters", last=last).where(in_periods(periods))
    for name, report in report_tables(counters, null_score=null_score).items():
        write_period_stats(report, f"{out}/reports/{name}", keys=PERIOD_KEYS)


def stream_reports(
    spark: SparkSession, drop_folder: str, out: str, *, null_score: str = "detractor", **read_options,
) -> StreamingQuery:
    """Take in new exports, and bring the reports of the periods they touch up to date.

    Rows go to ``<out>/clean``, counters to ``<out>/counters`` and each report to
    ``<out>/reports/<name>``, in a folder per period. A repeated batch replaces its rows and counters
    and reports the same again. The list of touched periods, as many as months at most, is all that
    reaches the driver.
    """

    def report(rows: DataFrame, batch_id: int) -> None:
        folder = f"{out}/counters/{BATCH}={batch_id}"
        counted = count_rows(rows)
        counted.hint("rebalance", *PERIOD_KEYS).write.mode("overwrite").partitionBy(*PERIOD_KEYS).parquet(folder)
        touched = spark.read.schema(counted.schema).parquet(folder).select(*PERIOD_KEYS).distinct().collect()
        refresh_reports(spark, out, [tuple(p) for p in touched], last=batch_id, null_score=null_score)

    return stream_ingest(
        spark, drop_folder, f"{out}/clean", f"{out}/progress", after=report,
        clean=partial(clean_manifestations, null_score=null_score), **read_options)


def read_report(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A current report, all periods; the folders' year and month are left out."""
    return spark.read.parquet(f"{out}/reports/{name}").drop(*PERIOD_KEYS)


def compact_reports(spark: SparkSession, out: str) -> bool:
    """Fold the rows and the counters of the finished batches."""
    last = last_batch(spark, f"{out}/clean")
    fold_batches(spark, f"{out}/clean", last, keys=PERIOD_KEYS)
    return fold_batches(spark, f"{out}/counters", last, keys=PERIOD_KEYS, merge=merge_counters)
