"""Cleaning a training corpus: the stages, in order, each on what its predecessor kept.

Quality rules (rejected documents go), line dedup (recurring lines go, and documents of which no word
is left), near-duplicates (the smallest id of each group stays), decontamination (documents that hold
benchmark text go), packing (pieces of what is left in sequences).

All stages but the last return the columns of ``documents``. Null and empty texts do not pass the
first stage; rows of equal ids are judged by their texts where a stage can tell them apart, and else
alike; an empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formpulse.llm.common import prepared, stored, table
from formpulse.llm.decontaminate import NARROW, STEP, contaminated
from formpulse.llm.linededup import dedup_lines, without_lines
from formpulse.llm.neardup import near_duplicates
from formpulse.llm.packing import pack
from formpulse.llm.quality import judge

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents are near-duplicates from this similarity of their word shingles; op7's query has its own.
NEAR_PERCENT = 80


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``left`` with a partner in ``right``, whose columns are named __<column>."""
    same = F.lit(True)
    for c in columns:
        same = same & left[c].eqNullSafe(right[f"__{c}"])
    return left.join(right, same, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the limits and are no outliers of their language and source."""
    prepared(spark)
    # The row's own content names it, so that rows of equal ids are judged each.
    named = docs.withColumn("__row", F.xxhash64("doc_id", "text", "lang", "source"))
    kept = judge(named, key="__row").where("kept").select("__row").distinct()
    return named.join(kept, "__row", "left_semi").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which no word is left go. n_chars is recounted
    where lines went."""
    prepared(spark)
    judged = dedup_lines(docs)
    text = without_lines(F.col("text"), F.col("__dropped"))
    changed = F.col("__dropped").isNotNull()
    out = judged.withColumn("__text", text).where(
        ~changed | (F.translate("__text", " \t\n\x0b\x0c\r", "") != ""))
    columns = {"text": F.col("__text"), "n_chars": F.when(changed, F.length("__text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    prepared(spark)
    kept = near_duplicates(docs, percent=NEAR_PERCENT).where("kept").select(F.col("doc_id").alias("__doc_id")).distinct()
    return _same(docs, kept, ["doc_id"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text, nor an excerpt of 80 bytes of one."""
    prepared(spark)
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), width=NARROW, stride=STEP)
    return found.where(F.size("__items") == 0).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, mixed by source, with their ids."""
    prepared(spark)
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_duplicate_groups),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Iterated estimates, template trees and token ids have no SQL form; tests/llm checks against plain
#: Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
