"""Tables that grow by batches, and their compaction while readers and the stream go on.

Batch ``n`` lies in ``batch_id=n``. A fold of all batches up to ``n`` is written to ``batch_id=-(n+1)``
and counts from the moment its line stands in ``<path>-folds``: readers then take the fold and later
batches, before that the batches themselves. A fold that fails leaves a folder that nobody reads.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch_id"


def read_json_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a folder, none where it does not exist yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def newest_fold(spark: SparkSession, path: str) -> int:
    """The last batch that a finished fold stands for, -1 without a fold."""
    return read_json_if_any(spark, f"{path}-folds", "upto bigint").agg(
        F.coalesce(F.max("upto"), F.lit(-1))).first()[0]


def read_batches(
    spark: SparkSession, path: str, *, last: int | None = None, schema: T.StructType | None = None,
) -> DataFrame:
    """Each row once, from the newest fold and the batches after it, up to ``last`` if given.

    Only their folders are scanned. The batch stays out of the columns.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())]))
    upto, batch = newest_fold(spark, path), F.col(BATCH)
    wanted = batch > upto if last is None else (batch > upto) & (batch <= last)
    if upto >= 0:
        wanted = wanted | (batch == -(upto + 1))
    return reader.parquet(path).where(wanted).drop(BATCH)


def fold_batches(
    spark: SparkSession, path: str, last: int, *, keys: Sequence[str],
    merge: Callable[[DataFrame], DataFrame] | None = None,
) -> bool:
    """Fold the finished batches up to ``last`` into few files per period; False if there is no news.

    ``merge`` may join rows, such as sums of counters. A repeated fold of the same batches writes
    the same rows. Folders that the fold before this one had replaced are deleted, so a reader has
    the time between two folds to finish.
    """
    before = newest_fold(spark, path)
    if last <= before:
        return False
    rows = read_batches(spark, path, last=last)
    rows = rows if merge is None else merge(rows)
    rows.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(
        f"{path}/{BATCH}={-(last + 1)}")
    line = spark.range(1).select(F.lit(last).alias("upto"), F.current_timestamp().alias("ts"))
    line.write.mode("append").json(f"{path}-folds")
    if before >= 0:
        _delete_replaced(spark, path, before)
    return True


def _delete_replaced(spark: SparkSession, path: str, upto: int) -> None:
    """Delete the batches up to ``upto`` and the folds before the one that stands for them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in files.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith(f"{BATCH}=") and (
            0 <= int(name[len(BATCH) + 1:]) <= upto or -(upto + 1) < int(name[len(BATCH) + 1:]) < 0
        ):
            files.delete(entry.getPath(), True)
