"""Packing of documents into fixed-length sequences under a mixture of sources.

Deficit round robin in units of one token: every source is a queue of its documents' tokens, and each
window gives a queue the quantum ``window x share`` plus the deficit (the fraction of a token) it
carries. After w of W windows a queue of n tokens has thus been served floor(w x n / W) tokens,
whatever partition its documents lie in; the deficit runs on across windows and partitions. Windows
follow each other without a gap, within a window the queues are served in turn, and the resulting
stream is cut every ``length`` tokens. Documents are cut where a window or a sequence ends, so only
the last sequence can be padded.

Two passes. The first tokenises, and writes ids with each document's place in its partition and
queue. Sums per (partition, queue) then give every document its place in its queue, and the second
pass computes, document by document, where its tokens fall: no tokens are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .tokens import encoder

LENGTH = 1024
#: Tokens of a window: what is kept to the target mixture.
WINDOW = 64 * LENGTH
#: Sources beyond this many share queues, so that a window is a bounded table.
QUEUES = 1024
END = (0).to_bytes(4, "little")

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, source string, window bigint, ids binary")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenised(docs: DataFrame, key: str, file: str) -> DataFrame:
    """doc_id, source, part, place (in the part's tokens of the source), doc_tokens, ids
    (little-endian unsigned 32 bit)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(file), TaskContext.get().partitionId()
        served: dict[str | None, int] = {}
        for batch in rows:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                ids = [encode(text or "") + END for text in some.column(1).to_pylist()]
                counts, places = [len(i) // 4 for i in ids], []
                for source, n in zip(some.column(2).to_pylist(), counts, strict=True):
                    places.append(served.get(source, 0))
                    served[source] = places[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(2), pa.array([part] * len(ids), pa.int32()),
                     pa.array(places, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "part", "place", "doc_tokens", "ids"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), "text", "source").mapInArrow(
        batches, "doc_id bigint, source string, part int, place bigint, doc_tokens bigint, ids binary")


def _starts(tokens: DataFrame) -> DataFrame:
    """__source, __part, queue, base (tokens of the queue before this part of the source), n.

    Sources are numbered in order, modulo QUEUES.
    """
    sums = tokens.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n"))
    numbered = Window.orderBy(F.col("source").asc_nulls_first())
    names = sums.select("source").distinct().select(
        F.col("source").alias("named"), ((F.row_number().over(numbered) - 1) % QUEUES).alias("queue"))
    earlier = Window.partitionBy("queue").orderBy("part", F.col("source").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    return sums.join(names, F.col("source").eqNullSafe(F.col("named"))).select(
        F.col("source").alias("__source"), F.col("part").alias("__part"), "queue",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), "n")


class Mixture:
    """Where tokens of queues fall in the packed stream; ``sizes`` are tokens by queue."""

    def __init__(self, sizes: list[int], window: int):
        self.sizes = np.array(sizes, dtype=np.int64)
        self.windows = max(1, -(-int(self.sizes.sum()) // window))
        self.whole, self.rest = self.sizes // self.windows, self.sizes % self.windows
        self.opened = lru_cache(maxsize=4096)(self._opened)

    def served(self, w: int) -> np.ndarray:
        """Tokens of each queue in the first w windows: floor(w x n / windows), without overflow."""
        return w * self.whole + w * self.rest // self.windows

    def _opened(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of window w: by queue the first token, the token after the last, and its stream place."""
        first, end = self.served(w), self.served(w + 1)
        turn = np.concatenate(([0], np.cumsum(end - first)[:-1]))
        return first, end, int(first.sum()) + turn

    def window_of(self, queue: int, token: int) -> int:
        """The window that serves a token: the last w with floor(w x n / windows) <= token."""
        return ((token + 1) * self.windows - 1) // int(self.sizes[queue])

    def pieces(self, queue: int, start: int, count: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(first token in the document, number, stream place, window) of ``count`` tokens from ``start``."""
        token, stop = start, start + count
        while token < stop:
            w = self.window_of(queue, token)
            first, end, at = self.opened(w)
            place = int(at[queue]) + token - int(first[queue])
            n = min(stop - token, int(end[queue]) - token, length - place % length)
            yield token - start, n, place, w
            token += n


def pack(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, window: int = WINDOW,
         file: str | None = None, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source,
    window, and the piece's ids (little-endian unsigned 32 bit; null if ``ids`` is false).

    The targets are the sources' shares of all tokens, so that all queues end with the last window.
    Null and empty texts are one end token; null sources are a queue of their own; null keys are kept
    and repeated rows are packed each; texts of any length are cut. An empty frame gives an empty
    frame. Other columns are not read.
    """
    file = file or vocabulary()
    tokens = stored(_tokenised(docs, key, file), "tokens")
    starts = stored(_starts(tokens), "token-starts")
    # At most QUEUES rows reach the driver.
    totals = {row.queue: row.n for row in starts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    sizes = [totals.get(q, 0) for q in range(max(totals, default=0) + 1)]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = Mixture(sizes, window)
        for batch in rows:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                out: list[list] = [[] for _ in range(9)]
                row_of: list[int] = []
                places, sizes_, data = (some.column(i).to_pylist() for i in (3, 4, 5))
                for row, queue in enumerate(some.column(2).to_pylist()):
                    whole = memoryview(data[row])
                    for start, n, at, w in mixture.pieces(queue, places[row], sizes_[row], length):
                        part = whole[4 * start: 4 * (start + n)]
                        row_of.append(row)
                        for column, value in zip(out, (start, n, zlib.crc32(part), sizes_[row],
                                                       at // length, at % length, w,
                                                       bytes(part) if ids else None), strict=False):
                            column.append(value)
                taken = pa.array(row_of, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(taken), *(pa.array(c, pa.int64()) for c in out[:6]),
                     some.column(1).take(taken), pa.array(out[6], pa.int64()), pa.array(out[7], pa.binary())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                     "source", "window", "ids"])

    # One row per source and part: broadcast while it is small, else a join by sort.
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("part") == F.col("__part"))
    placed = tokens.join(starts, same).select(
        "doc_id", "source", "queue", (F.col("place") + F.col("base")).alias("place"), "doc_tokens", "ids")
    return placed.mapInArrow(batches, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), ids=False).drop("ids")
