"""Benchmark decontamination by q-gram lemma filtering.

Benchmark texts are cut into overlapping windows. A window of m bytes that lies in a document with at
most e edits shares at least m + 1 - q (e + 1) of its q-grams with that place, on diagonals (place in
the document less place in the window) that differ by at most e. So the shared q-grams of a document
are counted by window and by overlapping bands of diagonals; regions below the bound are left out,
and the rest are verified by a banded alignment of the window against the region.

An excerpt of width + stride - 1 bytes holds a whole window wherever it starts, so none of that length
is missed. The query and the pipeline take windows of 64 bytes every 17: excerpts from 80 bytes, some 13
words. Benchmark texts too short for a bound are matched exactly, on word borders.

Documents are read in one pass for each block of the benchmark and are never shuffled: a block has
at most ``BLOCK_BYTES`` of benchmark text on average, and one block of q-grams is broadcast at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Q = 12
#: Bytes of a window at most, and of the steps between such windows of a longer text.
WIDTH, STRIDE = 160, 80
#: The same unless told otherwise: excerpts of 80 bytes are found.
NARROW, STEP = 64, 17
#: Edits allowed for each byte of a window.
RATE = 0.05
#: Shorter benchmark texts (normalised) are matched exactly.
LEAST = 32
BLOCK_BYTES = 2_000_000
#: Bytes of a document that are looked at together.
CHUNK = 1 << 16

_WORDS = re.compile(r"\w+")
_K = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    """Lower case, one blank for each run of white space."""
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def windows(text: bytes, width: int = WIDTH, stride: int = STRIDE) -> list[bytes]:
    if len(text) < LEAST:
        return []
    if len(text) <= width:
        return [text]
    starts = [*range(0, len(text) - width, stride), len(text) - width]
    return [text[s: s + width] for s in starts]


def edits(length: int) -> int:
    return int(length * RATE)


def bound(length: int) -> int:
    """Q-grams that a window must share with its place, at least 1."""
    return max(1, length + 1 - Q * (edits(length) + 1))


def grams(text: bytes) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place."""
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(x) < Q:
        return np.empty(0, np.uint64)
    two = x[:-1] | (x[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    n = len(x) - Q + 1
    mixed = (eight[:n] ^ (eight[:n] >> np.uint64(29))) * _K + four[8: 8 + n] * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))) * _K


class Phrases:
    """Short texts, by their first word, for exact matches on word borders.

    A text without a letter, digit or underscore must stand between blanks.
    """

    def __init__(self, items: list[tuple[int, bytes]]):
        self.by_word: dict[str, list[tuple[int, str, int]]] = {}
        self.signs: list[tuple[int, str]] = []
        for item, text in items:
            phrase = text.decode("utf-8", "surrogatepass")
            word = _WORDS.search(phrase)
            if word:
                self.by_word.setdefault(word[0], []).append((item, phrase, word.start()))
            else:
                self.signs.append((item, f" {phrase} "))

    def found(self, text: bytes) -> set[int]:
        if not self.by_word and not self.signs:
            return set()
        whole = text.decode("utf-8", "surrogatepass")
        out = {item for item, phrase in self.signs if phrase in f" {whole} "}
        if self.by_word.keys().isdisjoint(_WORDS.findall(whole)):
            return out
        for word in _WORDS.finditer(whole):
            for item, phrase, at in self.by_word.get(word[0], ()):
                start = word.start() - at
                end = start + len(phrase)
                if start >= 0 and whole.startswith(phrase, start) and not (
                        _WORDS.match(phrase[-1]) and _WORDS.match(whole[end: end + 1])):
                    out.add(item)
        return out


class Index:
    """Q-grams of a block of windows: sorted hashes with their (window, place) postings.

    Texts shorter than ``LEAST`` are phrases.
    """

    BITS = np.uint64(64 - 22)

    def __init__(self, items: list[tuple[int, bytes]]):
        self.phrases = Phrases([x for x in items if len(x[1]) < LEAST])
        items = [x for x in items if len(x[1]) >= LEAST]
        self.items = [item for item, _ in items]
        self.texts = [text for _, text in items]
        hashes = [grams(t) for t in self.texts]
        which = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if items else np.empty(0, np.int64)
        every = np.concatenate(hashes) if items else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes, self.which, self.place = every[order], which[order], place[order]
        self.keys, self.first = np.unique(self.hashes, return_index=True)
        self.last = np.append(self.first[1:], len(self.hashes))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys >> self.BITS).astype(np.int64)] = True
        self.bounds = np.array([bound(len(t)) for t in self.texts], np.int64)
        self.band = max((edits(len(t)) for t in self.texts), default=0) + 1

    def regions(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(window, start, end) of regions of a text that reach their bound."""
        h = grams(text)
        maybe = np.flatnonzero(self.bits[(h >> self.BITS).astype(np.int64)])
        if not len(maybe) or not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        maybe, at = maybe[hit], at[hit]
        n = self.last[at] - self.first[at]
        if not n.sum():
            return
        where = np.repeat(maybe, n)
        posting = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        which, diagonal = self.which[posting], where - self.place[posting]
        # Bands of twice the width, each overlapping the next by half. Diagonals start at -WIDTH.
        band = (diagonal + WIDTH) // self.band + 1
        found: set[tuple[int, int, int]] = set()
        for shift in (0, 1):
            key = which * (1 << 32) + (band + shift) // 2
            names, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            for i in np.flatnonzero(counts >= self.bounds[names >> 32]):
                own = diagonal[inverse == i]
                w = int(names[i] >> 32)
                found.add((w, int(own.min()), int(own.max())))
        for w, low, high in sorted(found):
            slack = edits(len(self.texts[w]))
            yield w, max(0, low - slack), min(len(text), high + len(self.texts[w]) + slack)

    def matches(self, text: bytes) -> dict[int, int]:
        """By item the least number of edits of a window that lies in the text within its budget."""
        best: dict[int, int] = dict.fromkeys(self.phrases.found(text), 0)
        overlap = 2 * WIDTH + Q
        for start in range(0, max(1, len(text) - overlap), CHUNK):
            for w, low, high in self.regions(text[start: start + CHUNK + overlap]):
                item, window = self.items[w], self.texts[w]
                if best.get(item) == 0:
                    continue
                allowed = edits(len(window))
                d = distance(window, text[start + low: start + high], allowed)
                if d <= allowed and d < best.get(item, allowed + 1):
                    best[item] = d
        return best


def distance(window: bytes, region: bytes, most: int) -> int:
    """Edits between a window and the nearest part of a region, or most + 1 if there are more.

    Banded: row by row over the window, keeping the places of the region from which at most ``most``
    edits are left to spend. The ends of the region are free.
    """
    if window in region:
        return 0
    text = np.frombuffer(region, np.uint8)
    n = len(text)
    steps = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    low, high = 0, n  # the band: outside it every cell exceeds the budget
    for i, c in enumerate(window, 1):
        now = np.full(n + 1, most + 1, np.int64)
        end = min(n, high + 1)
        now[low: end + 1] = np.minimum(now[low: end + 1], row[low: end + 1] + 1)
        now[low + 1: end + 1] = np.minimum(now[low + 1: end + 1], row[low:end] + (text[low:end] != c))
        part = now[low: end + 1] - steps[low: end + 1]
        now[low: end + 1] = np.minimum.accumulate(part) + steps[low: end + 1]
        alive = np.flatnonzero(now[low: end + 1] <= most)
        if not len(alive):
            return most + 1
        low, high, row = low + int(alive[0]), low + int(alive[-1]), np.minimum(now, most + 1)
    return int(row[low: high + 1].min())


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id",
                 block_bytes: int = BLOCK_BYTES, width: int = NARROW, stride: int = STEP) -> DataFrame:
    """The rows of ``docs`` with __items: array<struct<item_id, edits>>, sorted, of benchmark texts
    with a window in the text, empty for clean rows.

    Excerpts of width + stride - 1 bytes are found wherever they start; ``width`` is ``WIDTH`` at most.
    Null and empty texts on either side match nothing; benchmark texts shorter than ``LEAST`` match
    exactly, on word borders; texts are read whole, in overlapping chunks; null item ids are judged but listed as
    null; repeated rows are judged each. An empty benchmark leaves every row clean. Other columns are
    carried along unchanged, but for one named __items.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = "array<struct<item_id: bigint, edits: int>>"
    shape = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))
    out = docs.drop("__items").withColumn("__items", F.array().cast(kind))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        whole = ((row.item_id, normal(row.text)) for row in own.toLocalIterator())
        cut = [(item, w) for item, text in whole if text for w in windows(text, width, stride) or [text]]
        if not cut:
            continue
        shared = spark.sparkContext.broadcast(cut)
        place = out.columns.index("text")
        last = len(out.columns) - 1

        name = uuid.uuid4().hex

        def batches(rows: Iterator[pa.RecordBatch], name=name, shared=shared, place=place,
                    last=last) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared)
            for batch in rows:
                found = []
                for text, before in zip(batch.column(place), batch.column(last).to_pylist(), strict=True):
                    here = index.matches(normal(text.as_py()))
                    listed = before + [{"item_id": i, "edits": d} for i, d in here.items()]
                    found.append(sorted(listed, key=lambda x: (x["item_id"] is not None, x["item_id"], x["edits"])))
                yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(found, shape)], batch.schema.names)

        out = out.mapInArrow(batches, out.schema)
    return out


_HELD: dict[str, Index] = {}


def _index(name: str, shared) -> Index:
    """One index for each worker: that of the block it works on."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Index(shared.value)
    return _HELD[name]


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark texts it holds."""
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"),
                         width=NARROW, stride=STEP)
    return found.select(
        "doc_id", F.size("__items").cast("long").alias("n_items"),
        F.array_join(F.expr("transform(__items, x -> concat(coalesce(cast(x.item_id AS string), ''), ':', x.edits))"), ",").alias("items"),
        (F.size("__items") > 0).alias("contaminated"))
