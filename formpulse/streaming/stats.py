"""Daily counts per kind and sector, kept current while manifestations arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STAT_KEYS = ("dia", "tipo", "setor")


def daily_type_sector_counts(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count per day, kind and sector, and ``keys`` such as ``site``; rows without a date share the
    null day. Days are those of the forms' local clock readings."""
    dated = rows.withColumn("dia", F.col("data").cast("date"))
    return dated.groupBy(*keys, *STAT_KEYS).agg(F.count("*").alias("n"))


def stream_period_stats(
    stream: DataFrame, path: str, checkpoint: str, *, keys: tuple[str, ...] = (),
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the counts in a table: each micro-batch adds a folder with the counts of its own rows.

    There is no state and no watermark, so every row counts however late it comes and however the
    input is cut into batches. A batch that is repeated after a failure overwrites its own folder.
    Its counters are one small file, which appears at once. Read with :func:`read_period_stats`.
    """

    def write_counts(batch: DataFrame, batch_id: int) -> None:
        counts = daily_type_sector_counts(batch, keys)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/first={batch_id}/last={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_counts)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _current(spark: SparkSession, path: str) -> DataFrame:
    """The table without folders that a compaction has summed up."""
    table = spark.read.parquet(path)
    upto = table.where("first = -1").agg(F.max("last")).first()[0]
    if upto is None:
        return table
    return table.where((F.col("first") > upto) | ((F.col("first") == -1) & (F.col("last") == upto)))


def read_period_stats(
    spark: SparkSession, path: str, *, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Current counts: the sum over all batches."""
    return _current(spark, path).groupBy(*keys, *STAT_KEYS).agg(F.sum("n").alias("n"))


def compact_period_stats(
    spark: SparkSession, path: str, *, keys: tuple[str, ...] = ()
) -> None:
    """Sum the batches up to now into one folder of the same table.

    The folder names the batches it stands for, so readers leave those out from the moment its one
    file appears, and a running stream goes on adding its own. A repeated compaction writes the
    same sums. Folders that are summed up may be deleted at any time.
    """
    current = _current(spark, path)
    last = current.agg(F.max("last")).first()[0]
    sums = current.where(F.col("last") <= last).groupBy(*keys, *STAT_KEYS).agg(F.sum("n").alias("n"))
    sums.coalesce(1).write.mode("overwrite").parquet(f"{path}/first=-1/last={last}")
