"""Whitening of embeddings by distributed block matrices.

Each entry c becomes the whole number x = floor(64 c) + 1000000. Rows are numbered without gaps and cut
into blocks of ``ROWS`` rows, each built by one task: the column sums S and the count n give the exact
whole numbers n x - S, and these over n are the centred entries. The scatter matrix is the product of the
transposed block matrix with itself, cut along its long side so that no task holds more than a few blocks;
it has one entry per pair of dimensions, and only that comes to the driver, where its eigenvectors are
found. A second block product projects the rows on the eigenvectors over the roots of their eigenvalues.

For the projection the blocks lie on a square grid, and the whitening matrix stands once per column of the
grid on the diagonal of its block matrix. The product is the same, row by row, but the library deals the
blocks of a square over as many tasks as there are, and those of a single tall column over the square root
of that number.

The identity error is measured: the projected rows are multiplied by themselves once more. Centred rows
have sums of zero, and so have their projections.

Rows are left out if the vector is null or empty, holds a null, an entry that is not finite or of 2^34 or
more, or has not the commonest length (the longer one among equals). Repeated rows and ids count each.
Components whose eigenvalue is zero to double precision have no whitened value (null), nor has the identity
error any without a component. A deviation beyond the range of long is null. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread, stored, table

#: Rows of a block.
ROWS = 4096
#: Entries are multiplied by this, rounded down and moved by that.
SCALE, OFFSET = 64, 1_000_000
#: Entries of this size or more are treated as not finite.
HUGE = float(1 << 34)

_INTS = pa.list_(pa.field("element", pa.int32(), nullable=False))
_DOUBLES = pa.list_(pa.field("element", pa.float64(), nullable=False))


def _dense(matrix: np.ndarray) -> pa.StructArray:
    """One matrix as the library's matrix type, column after column."""
    lengths = pa.array([0, matrix.size], pa.int32())
    columns = {
        "type": pa.array([1], pa.int8()), "numRows": pa.array([matrix.shape[0]], pa.int32()),
        "numCols": pa.array([matrix.shape[1]], pa.int32()), "colPtrs": pa.nulls(1, _INTS), "rowIndices": pa.nulls(1, _INTS),
        "values": pa.ListArray.from_arrays(lengths, pa.array(matrix.ravel(order="F")), type=_DOUBLES),
        "isTransposed": pa.array([False])}
    optional = ("colPtrs", "rowIndices", "values")
    return pa.StructArray.from_arrays(
        list(columns.values()), fields=[pa.field(k, v.type, nullable=k in optional) for k, v in columns.items()])


def _whole(vectors: pa.Array, size: int) -> np.ndarray:
    """The rows' whole numbers x."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return np.floor(entries * SCALE).astype(np.int64) + OFFSET


@dataclass(frozen=True)
class Fit:
    """What the fit list says of all rows: count, column sums, eigenvalues by size, their unit
    vectors as columns, their shares, which of them are not zero, and the measured identity error."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    whole: np.ndarray
    identity_error: float | None = None


def _usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows with a usable vector of the commonest length, and that length (0 without rows)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < HUGE))
    sound = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    common = sound.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return (sound, 0) if common is None else (sound.where(F.size(vector) == common["size"]), common["size"])


def _numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """A written table's rows with a gapless number ``at``, by file and place in the file; their count."""
    located = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    # One row per file that a task has written.
    files = located.groupBy("file").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = files.select("file", F.coalesce(before, F.lit(0)).alias("before"), "rows")
    n = offsets.agg(F.sum("rows")).first()[0] or 0
    return located.join(offsets.drop("rows"), "file").withColumn(
        "at", F.col("before") + F.col("place")).drop("file", "place", "before"), n


def _sums(rows: DataFrame, size: int) -> list[int]:
    """Exact sum of x in each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                total = _whole(batch.column(0), size).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "s"])

    parts = rows.select("vector").mapInArrow(partial, "i int, s bigint")
    totals = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(r["s"]) for r in sorted(totals, key=lambda r: r["i"])]


def _deviation(exact: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, null beyond the range of long."""
    largest = int(np.abs(exact).max(initial=0))
    if largest * largest * exact.shape[1] < 1 << 63:
        return (exact.astype(np.int64) ** 2).sum(axis=1).tolist()
    totals = [sum(int(v) ** 2 for v in row) for row in exact]
    return [t if t < 1 << 63 else None for t in totals]


def _blocks(numbered: DataFrame, size: int, n: int, sums: list[int]) -> DataFrame:
    """Blocks of centred rows: number, matrix, and the rows' keys and deviations in order.

    A group holds ``ROWS`` rows at most; the last block is filled up with rows of zeros.
    """
    middle = [s // n for s in sums]
    left = [s - n * m for s, m in zip(sums, middle)]
    key_type = numbered.schema["key"].dataType

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        moved = _whole(group.column("vector"), size) - np.array(middle, dtype=np.int64)
        wide = np.int64 if (int(np.abs(moved).max()) + 1) * n < 1 << 62 else object
        exact = moved.astype(wide) * n - np.array(left, dtype=wide)  # n x - S
        centred = np.zeros((ROWS, size))
        centred[:len(exact)] = (exact / n).astype(np.float64)
        return pa.Table.from_arrays([
            pa.array([group.column("block")[0].as_py()], pa.int64()), _dense(centred),
            pa.array([group.column("key").to_pylist()]).cast(pa.list_(group.schema.field("key").type)),
            pa.array([_deviation(exact)], pa.list_(pa.int64()))], names=["block", "matrix", "keys", "deviations"])

    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("matrix", MatrixUDT()),
        T.StructField("keys", T.ArrayType(key_type)), T.StructField("deviations", T.ArrayType(T.LongType()))])
    return numbered.withColumn("block", F.floor(F.col("at") / ROWS)).groupBy("block").applyInArrow(build, schema)


def _block_matrix(blocks: DataFrame, row: Column, column: Column, shape: tuple[int, int], grid: tuple[int, int]):
    """A block matrix of the library from a frame of blocks; ``grid`` is its size in blocks."""
    at = F.struct(row.cast("long").alias("blockRowIndex"), column.cast("long").alias("blockColIndex"))
    frame = blocks.select(at.alias("at"), "matrix")
    return callMLlibFunc("createBlockMatrix", frame, *shape, grid[0] * shape[0], grid[1] * shape[1])


def _scatter(blocks: DataFrame, width: int, count: int) -> np.ndarray:
    """Product of the transposed tall matrix with itself."""
    tall = _block_matrix(blocks, F.col("block"), F.lit(0), (ROWS, width), (count, 1))
    # Cut along the long side: a task multiplies a few pairs of blocks and adds them up.
    splits = min(count, max(spread(blocks), math.isqrt(count)))
    product = BlockMatrix(tall.transpose().multiply(tall, splits), width, width)
    return product.toLocalMatrix().toArray()


def _project(blocks: DataFrame, whitening: np.ndarray, count: int) -> DataFrame:
    """Blocks of the projected rows: number and matrix."""
    spark, (size, width) = blocks.sparkSession, whitening.shape
    side = math.isqrt(count - 1) + 1
    number = F.col("block")
    square = _block_matrix(blocks, F.floor(number / side), number % side, (ROWS, size), (side, side))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), _dense(whitening)], names=["i", "matrix"])

    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("matrix", MatrixUDT())])
    # One small task: the root of the number of blocks, each with the small matrix.
    diagonal = _block_matrix(
        spark.range(side, numPartitions=min(side, spread(blocks))).mapInArrow(place, schema), F.col("i"), F.col("i"), (size, width), (side, side))
    return callMLlibFunc("getMatrixBlocks", square.multiply(diagonal)).select(
        (F.col("_1._1").cast("long") * side + F.col("_1._2")).alias("block"), F.col("_2").alias("matrix"))


def whiten(df: DataFrame, *, vector: str = "embedding", key: str = "vec_id", components: int = 32) -> tuple[DataFrame, Fit | None]:
    """Rows (key, deviation, whitened) and the fit; ``whitened`` is an array of the largest
    components. Without a usable row the frame is empty and there is no fit."""
    spark = df.sparkSession
    usable, size = _usable(df.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector")
    schema = T.StructType([
        T.StructField(key, usable.schema["key"].dataType), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if not size:
        return spark.createDataFrame([], schema), None
    numbered, n = _numbered(stored(usable, "vectors"))
    sums = _sums(numbered, size)
    blocks = stored(_blocks(numbered, size, n, sums), "blocks")
    count = -(-n // ROWS)
    covariance = _scatter(blocks, size, count) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    whole = values > max(values[0], 0) * size * np.finfo(float).eps * 8
    width = min(components, size)
    roots = np.sqrt(np.where(whole, values, 1.0))
    whitening = np.where(whole, vectors / roots, 0.0)[:, :width]
    projected = stored(_project(blocks, whitening, count), "projected")
    error = None
    if (kept := whole[:width]).any():
        error = float(np.abs((_scatter(projected, width, count) / n - np.eye(width))[np.ix_(kept, kept)]).max())
    explained = np.divide(values, trace, out=np.full(size, np.nan), where=trace > 0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, deviations, matrix in zip(batch.column(0), batch.column(1), batch.column(2)):
                entries = matrix["values"].values.to_numpy().reshape((ROWS, width), order="F")[:len(keys)]
                entries = np.ascontiguousarray(entries).ravel()
                flat = pa.array(entries, mask=np.tile(~kept, len(keys)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * width, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([keys.values, deviations.values, lists], names=schema.names)

    named = blocks.select("block", "keys", "deviations").join(projected, "block")
    out = named.select("keys", "deviations", "matrix").mapInArrow(rows, schema)
    return out, Fit(n, np.array(sums, dtype=object), values, vectors, explained, whole, error)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding, and how exact they are."""
    out, fit = whiten(table(spark, sf_dir, "embeddings"))
    component, value = F.col("pos") + 1, F.col("col")
    shares: list[float | None] = [] if fit is None else [None if math.isnan(x) else float(x) for x in fit.explained[:32]]
    explained = F.get(F.array(*(F.lit(x).cast("double") for x in shares)), F.col("pos"))
    return out.select("vec_id", "deviation", F.posexplode("whitened")).select(
        "vec_id", component.alias("component"), F.lit(fit.n if fit else None).cast("long").alias("n"), "deviation",
        value.alias("whitened"), (explained if shares else F.lit(None)).cast("double").alias("explained"),
        F.lit(fit.identity_error if fit else None).cast("double").alias("identity_error"))
