"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formpulse.session import work_folder

Query = Callable[[SparkSession, str], DataFrame]

#: The white space that separates words, as a Java regular expression.
SPACES = "[\\x20\\x09-\\x0D]+"


def prepared(spark: SparkSession) -> SparkSession:
    """Settings for long rows: adaptive execution, and few rows in an Arrow batch."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a reread, not the work before it.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> int:
    """Shuffle partitions of the session, for helpers that need a number."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

