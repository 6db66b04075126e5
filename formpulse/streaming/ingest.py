"""New form exports in a drop folder become rows of the clean table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from formpulse.functions.numbers import count_when
from formpulse.sources.audit import audit_flags, audit_status, write_audit
from formpulse.sources.csv import MALFORMED, apply_null_tokens, layout_schema, split_malformed
from formpulse.sources.normalize import clean_manifestations
from formpulse.sources.sinks import PERIOD_KEYS
from formpulse.streaming.folds import BATCH, fold_batches, read_batches, read_json_if_any

#: The age in seconds from which a table counts as stale.
MAX_AGE = 3600


def read_survey_stream(
    spark: SparkSession, drop_folder: str, layout: str, *, null_tokens: str = "wide",
    multi_line: bool = True, max_files: int = 1000,
) -> DataFrame:
    """Form exports of a folder as an all-text stream; at most ``max_files`` per micro-batch.

    Records with another number of columns are kept whole in the column ``MALFORMED``.
    """
    stream = (
        spark.readStream.schema(layout_schema(layout, MALFORMED))
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("maxFilesPerTrigger", max_files)
        .csv(drop_folder)
    )
    return apply_null_tokens(stream, null_tokens, MALFORMED)


def stream_ingest(
    spark: SparkSession,
    drop_folder: str,
    table_path: str,
    checkpoint: str,
    *,
    layout: str = "manifestation10",
    clean: Callable[[DataFrame], DataFrame] = clean_manifestations,
    keys: Sequence[str] = PERIOD_KEYS,
    after: Callable[[DataFrame, int], None] | None = None,
    **read_options,
) -> StreamingQuery:
    """Clean the exports that arrived since the last run, add them to the table, and stop.

    The checkpoint remembers which files were taken. A batch writes into a folder of its own, which
    a repetition overwrites, so a run that loses executors or is restarted neither skips nor repeats
    a file. Each period of a batch gets few files, and a hot one is split.

    A batch is parsed once: its counters for the log are observed while its rows are written, behind
    the shuffle, where a repeated task does not count twice. ``clean`` must pass extra columns
    through, as the normalisers do; rows that it leaves out are not counted. Malformed records go to
    ``<table_path>-rejects``, which takes a second scan of the batches that have any. ``after`` gets
    the batch's written rows and its number. Last, the batch adds its line to ``<table_path>-log``,
    from when on it counts as finished.
    """
    flags = audit_flags(MALFORMED)
    marked = {name: f"__{name}" for name in flags}

    def take(batch: DataFrame, batch_id: int) -> None:
        folder = f"{BATCH}={batch_id}"
        seen = Observation()
        rows = clean(batch.withColumns({marked[n]: flag for n, flag in flags.items()}).drop(MALFORMED))
        counted = rows.hint("rebalance", *keys).observe(
            seen, F.count(F.lit(1)).alias("n_rows"), *(count_when(F.col(marked[n])).alias(n) for n in flags))
        good = counted.where(~F.col(marked["n_malformed"])).drop(*marked.values())
        good.write.mode("overwrite").partitionBy(*keys).parquet(f"{table_path}/{folder}")
        counts = {name: seen.get.get(name, 0) for name in ("n_rows", *flags)}
        if counts["n_malformed"]:
            split_malformed(batch)[1].write.mode("overwrite").json(f"{table_path}-rejects/{folder}")
        if after is not None:
            after(spark.read.schema(good.schema).parquet(f"{table_path}/{folder}"), batch_id)
        line = spark.range(1).select(*(F.lit(n).cast("long").alias(name) for name, n in counts.items()))
        write_audit(audit_status(line, drop_folder), f"{table_path}-log/{folder}", mode="overwrite")

    stream = read_survey_stream(spark, drop_folder, layout, **read_options)
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(take)
        .trigger(availableNow=True)
        .start()
    )


def last_batch(spark: SparkSession, table_path: str) -> int:
    """The number of the last finished batch, -1 before the first."""
    log = read_json_if_any(spark, f"{table_path}-log", f"ts timestamp, {BATCH} bigint")
    return log.agg(F.coalesce(F.max(BATCH), F.lit(-1))).first()[0]


def read_ingested(
    spark: SparkSession, table_path: str, *, columns: Sequence[str] = (), schema: T.StructType | None = None,
) -> DataFrame:
    """The rows of all finished batches, whether they are folded or not."""
    rows = read_batches(spark, table_path, last=last_batch(spark, table_path), schema=schema)
    return rows.select(*columns) if columns else rows


def compact_ingested(
    spark: SparkSession, table_path: str, *, keys: Sequence[str] = PERIOD_KEYS
) -> bool:
    """Fold the finished batches into few files per period; see :mod:`formpulse.streaming.folds`.

    From then on read the table with :func:`read_ingested`.
    """
    return fold_batches(spark, table_path, last_batch(spark, table_path), keys=keys)


def table_age(spark: SparkSession, table_path: str, now: dt.datetime | None = None) -> float | None:
    """Seconds since the last finished batch, or the last look for news; None before the first."""
    logged, looked = (read_json_if_any(spark, f"{table_path}-{part}", "ts timestamp").select("ts")
                      for part in ("log", "looks"))
    finished = logged.unionAll(looked)
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return finished.agg((at.cast("double") - F.max("ts").cast("double"))).first()[0]


def refresh_if_stale(
    spark: SparkSession,
    drop_folder: str,
    table_path: str,
    checkpoint: str,
    *,
    max_age: float = MAX_AGE,
    now: dt.datetime | None = None,
    ingest: Callable[..., StreamingQuery] = stream_ingest,
    **options,
) -> bool:
    """Take in new exports if the table is older than ``max_age`` seconds; says whether it was.

    The age is that of the last finished batch in the table's log, or of the last look, for a look
    that finds nothing new leaves a line of its own in ``<table_path>-looks``. A fresh table is not
    touched, however many exports wait.
    """
    age = table_age(spark, table_path, now)
    if age is not None and age <= max_age:
        return False
    ingest(spark, drop_folder, table_path, checkpoint, **options).awaitTermination()
    look = spark.range(1).select(F.current_timestamp().alias("ts"))
    look.write.mode("overwrite").json(f"{table_path}-looks")
    return True
