"""CSV exports of the forms, read by position as text."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formpulse import fixed_values as fv

MALFORMED = "_malformed"


def layout_schema(layout: str, malformed_column: str | None = None) -> T.StructType:
    """All-text schema of a layout, in column order."""
    names = [*fv.LAYOUTS[layout], *([malformed_column] if malformed_column else [])]
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def apply_null_tokens(df: DataFrame, null_tokens: str, malformed_column: str | None = None):
    """Decide what text means missing, in every column but the malformed one.

    Spark's parser gives null for an unquoted blank. Where a blank is not one of the words that
    mean missing, it becomes ``''`` again.
    """
    words = list(fv.NULL_TOKENS[null_tokens])

    def decide(name: str):
        text = F.col(name) if "" in words else F.coalesce(name, F.lit(""))
        return F.when(~text.isin(words), text).alias(name)

    return df.select(*(F.col(c) if c == malformed_column else decide(c) for c in df.columns))


def read_survey_csv(
    spark: SparkSession,
    path: str | list[str],
    layout: str,
    *,
    null_tokens: str = "blank",
    multi_line: bool = True,
    malformed_column: str | None = None,
    mode: str | None = None,
) -> DataFrame:
    """Read form exports (header, comma, UTF-8, quotes doubled) as an all-text frame.

    ``layout`` names a positional layout of ``fixed_values.LAYOUTS``; header words are ignored.
    ``null_tokens`` chooses which words mean missing: ``blank``, ``na_only`` (blank stays ``''``)
    or ``wide``. A record with another number of columns stops the job, or is kept whole in
    ``malformed_column`` if given (see :func:`split_malformed`). Comments may hold line breaks, so
    ``multi_line`` is on and a file is read by one task: land exports as many files. Exports
    without line breaks can switch it off and be split.
    """
    reader = (
        spark.read.schema(layout_schema(layout, malformed_column))
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("mode", mode or ("PERMISSIVE" if malformed_column else "FAILFAST"))
        .option("emptyValue", "")
    )
    if malformed_column:
        reader = reader.option("columnNameOfCorruptRecord", malformed_column)
    return apply_null_tokens(reader.csv(path), null_tokens, malformed_column)


def split_malformed(df: DataFrame, malformed_column: str = MALFORMED) -> tuple[DataFrame, DataFrame]:
    """The well-formed records, and the others: first column and whole record."""
    # Spark refuses to scan the malformed column alone, so the test names the first one too.
    scanned = F.coalesce(F.col(df.columns[0]), F.lit("")) != F.lit("\x00")
    bad = F.col(malformed_column).isNotNull() & scanned
    rejects = df.where(bad).select(
        F.col(df.columns[0]).alias("primeiro"), F.col(malformed_column).alias("registro"))
    return df.where(~bad).drop(malformed_column), rejects


def rename_positional(df: DataFrame, layout: str) -> DataFrame:
    """Give the columns of a frame their canonical names by position."""
    names = fv.LAYOUTS[layout]
    if len(df.columns) != len(names):
        raise ValueError(
            f"layout {layout} has {len(names)} columns, the frame has {len(df.columns)}"
        )
    return df.toDF(*names)


def header_arities(spark: SparkSession, path: str | list[str]) -> dict[str, int]:
    """The number of columns in the header of every file of a folder.

    One distributed pass over the files' lines, unparsed, keeps the first of each; the list of files,
    which Spark holds on the driver for any scan, is what comes back. Quoted commas do not count. A
    header must stand on one line.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    # Lines of a file that lie in its first block come in order.
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    plain = F.regexp_replace("header", '"([^"]|"")*"', "")
    arity = F.length(plain) - F.length(F.replace(plain, F.lit(","))) + 1
    return {unquote(r["file"]): r["n"] for r in first.select("file", arity.alias("n")).collect()}


def read_mixed_csv(
    spark: SparkSession, path: str | list[str], prefix: str, *, malformed_column: str | None = None, **options,
) -> DataFrame:
    """Exports of one form family in several layouts, each file read by that of its own header.

    The columns are those of the family's widest layout; what a file's layout does not have is null.
    Files whose header fits no layout stop the run, or with ``malformed_column`` go there whole, as
    their records are read by the widest. Options are those of :func:`read_survey_csv`.
    """
    layouts = {len(names): layout for layout, names in fv.LAYOUTS.items() if layout.startswith(prefix)}
    widest = layouts[max(layouts)]
    files: dict[str, list[str]] = {}
    for file, arity in sorted(header_arities(spark, path).items()):
        if arity not in layouts and malformed_column is None:
            layout_by_arity(prefix, arity)
        files.setdefault(layouts.get(arity, widest), []).append(file)
    if not files:
        return read_survey_csv(spark, path, widest, malformed_column=malformed_column, **options)
    columns = layout_schema(widest, malformed_column).names
    parts = [read_survey_csv(spark, group, layout, malformed_column=malformed_column, **options)
             for layout, group in files.items()]
    return reduce(lambda a, b: a.unionByName(b), (
        part.select(*(F.col(c) if c in part.columns else F.lit(None).cast("string").alias(c) for c in columns))
        for part in parts))


def header_layout(spark: SparkSession, path: str | list[str], prefix: str) -> str:
    """Layout of a form family by the width of the header line of an export."""
    first = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return layout_by_arity(prefix, len(first.columns))


def layout_by_arity(prefix: str, n_columns: int) -> str:
    """Layout of a form family (``general``, ``ambulatory``, ...) with this many columns."""
    for layout, names in fv.LAYOUTS.items():
        if layout.startswith(prefix) and len(names) == n_columns:
            return layout
    raise ValueError(f"no {prefix} layout has {n_columns} columns")
