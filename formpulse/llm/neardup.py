"""Near-duplicate groups by HyperMinHash over word shingles.

1. Each text gives its set of five-word shingles, hashed to 64 bits. The hash space is cut into
   buckets; of the least hash in a bucket a register keeps the leading zeros of its place in the
   bucket and the mantissa bits that follow. Registers are banded; an empty band gives no key.
2. Texts with the same words are one vertex (the smallest id), so copies are never paired.
3. Vertices that share a band key are brought together as neighbourhoods: components of the stars
   around each key's smallest vertex. Keys, not texts, are shuffled for this.
4. Within a neighbourhood registers are rebuilt from the sets, pairs whose collision-corrected
   estimate is too low are left out, and the rest are confirmed on the full sets. Neighbourhoods
   are dealt to tasks in blocks of bounded size. First each block is confirmed in itself, together
   with the neighbourhood's landmarks, which join blocks of one dense group. Where there were several
   blocks, the vertices of each band key on which different components still meet are confirmed
   once more (in pairs of blocks, if they are many), so that no link is lost.
5. Components of the confirmed links give the groups.

A task returns a spanning forest of its links, never all pairs. The width of a band and the margin of
the estimate follow from the wanted similarity. At 0.85 192 registers in bands of six miss a pair by
all bands once in four million; the estimate, with a standard error of 0.026 and a margin of 0.13,
misses 2.3 in a million (binomial tail). At 0.80 the bands have five registers and miss one pair in
3.5 million (six would miss one in 17,000); the estimate, with a standard error of 0.029 and a margin
of 0.15, misses one in two million.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, stored, table
from .graphs import components

SHINGLE = 5
#: Registers of a signature, and of its widest bands.
REGISTERS, BAND = 192, 6
#: Pairs at the wanted similarity that all bands together may miss.
MISSED = 3e-7
MANTISSA = 24
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Vertices of a block, the shingles it may hold, and landmarks that each block of a neighbourhood is seen with.
BLOCK, BLOCK_SHINGLES, LANDMARKS = 1024, 2_000_000, 64

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31, _S32 = (np.uint64(n) for n in (30, 27, 31, 32))
_LOW = np.uint64(0xFFFFFFFF)


class _Hashes(dict):
    """64-bit hashes of words met before."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) > 500_000:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(found: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a list of words; all words if there are fewer."""
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, n)
    size = min(size, n)
    x = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        x = _mix((x + hashes[k: k + n - size + 1]) * _STEP + np.uint64(k))
    return np.unique(x)


def registers(hashes: np.ndarray) -> np.ndarray:
    """By bucket 0 if empty, else leading zeros + 1 above the mantissa bits of the least hash."""
    out = np.zeros(REGISTERS, np.uint64)
    scaled = (hashes >> _S32) * np.uint64(REGISTERS)
    bucket = (scaled >> _S32).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: the least hash of each bucket
    # 52 bits of the place within the bucket: what the scaling left over, then the hash's low bits.
    place = ((scaled[first] & _LOW) << np.uint64(20)) | ((hashes[first] & _LOW) >> np.uint64(12))
    exponent = np.frexp(place.astype(np.float64))[1].astype(np.int64)  # bit length, 0 for 0
    zeros = np.uint64(52) - exponent.astype(np.uint64)
    shift = exponent - 1 - MANTISSA
    left, right = np.maximum(-shift, 0).astype(np.uint64), np.maximum(shift, 0).astype(np.uint64)
    mantissa = ((place << left) >> right) & np.uint64((1 << MANTISSA) - 1)
    out[bucket[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa
    return out


def band_width(percent: int) -> int:
    """Registers of the widest bands that miss no more than ``MISSED`` of the pairs at ``percent``."""
    return next((b for b in range(BAND, 1, -1) if (1 - (percent / 100) ** b) ** (REGISTERS // b) <= MISSED), 1)


def margin(percent: int) -> float:
    """Five standard errors of the estimate at ``percent``, rounded up to hundredths."""
    return math.ceil(500 * math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)) / 100


def band_keys(regs: np.ndarray, width: int = BAND) -> np.ndarray:
    """Keys of the bands that are not empty, as signed 64-bit. Registers over from whole bands are in none."""
    bands = regs[: len(regs) // width * width].reshape(-1, width)
    x = np.arange(len(bands), dtype=np.uint64)
    for k in range(width):
        x = _mix((x + bands[:, k]) * _STEP + np.uint64(k))
    return x[bands.any(axis=1)].view(np.int64)


def estimate(match: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Jaccard estimates from matching and non-empty registers, less the matches by collision.

    Two unrelated registers agree in leading zeros and mantissa with probability
    0.17 * 2 ** -MANTISSA.
    """
    chance = 0.1699 * 2.0 ** -MANTISSA
    return (match / np.maximum(held, 1) - chance) / (1 - chance)


def _signatures(docs: DataFrame, key: str, width: int) -> DataFrame:
    """doc_id, words (16-byte digest of the words), n_shingles, keys of bands of ``width`` registers."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            digests, sizes, keys = [], [], []
            for text in batch.column(1):
                found = words(text.as_py())
                digests.append(xxhash.xxh3_128_digest(b" ".join(found)))
                hashes = shingles(found)
                sizes.append(len(hashes))
                keys.append(band_keys(registers(hashes), width) if len(hashes) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "words", "n_shingles", "keys"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), "text").mapInArrow(
        batches, "doc_id bigint, words binary, n_shingles bigint, keys array<bigint>")


def _labels(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """By set the least place it is linked with, over chains of confirmed links."""
    m = len(sets)
    label = np.arange(m)
    if m < 2:
        return label
    regs = np.stack([registers(s) for s in sets])
    sizes = np.array([len(s) for s in sets], np.int64)
    # Pairs that may pass: by size, and by the estimate.
    likely = np.zeros((m, m), bool)
    for i in range(m):
        near = np.arange(i + 1, m)
        near = near[np.minimum(sizes[i], sizes[near]) * 100 >= percent * np.maximum(sizes[i], sizes[near])]
        if len(near):
            other = regs[near]
            held = ((other | regs[i]) != 0).sum(axis=1)
            match = ((other == regs[i]) & (other != 0)).sum(axis=1)
            likely[i, near] = estimate(match, held) >= percent / 100 - margin(percent)
    rows = np.flatnonzero(likely.any(axis=0) | likely.any(axis=1))
    if not len(rows):
        return label
    # Intersections: shingles that two of these sets hold, as 0/1 columns, in parts.
    lengths = sizes[rows]
    owner = np.repeat(np.arange(len(rows)), lengths)
    every, inverse, counts = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(every), -1, np.int64)
    place[shared] = np.arange(len(shared))
    column = place[inverse]
    common = np.zeros((len(rows), len(rows)), np.float32)
    for start in range(0, len(shared), 4096):
        here = (column >= start) & (column < start + 4096)
        part = np.zeros((len(rows), min(4096, len(shared) - start)), np.float32)
        part[owner[here], column[here] - start] = 1
        common += part @ part.T
    both = np.rint(common).astype(np.int64)
    union = lengths[:, None] + lengths[None, :] - both
    linked = (100 * both >= percent * union) & (likely | likely.T)[np.ix_(rows, rows)]
    np.fill_diagonal(linked, True)
    small = np.arange(len(rows))
    while True:
        least = np.where(linked, small[None, :], len(rows)).min(axis=1)
        least = least[least]
        if (least == small).all():
            break
        small = least
    label[rows] = rows[small]
    return label


def _confirmed(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each task's vertices; ``dealt`` has task, vertex, text."""

    def links(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        label = _labels(sets, percent)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        ids_ = np.array(ids, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids_[moved]), pa.array(ids_[label[moved]])], ["a", "b"])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        for batch in rows:
            for task, vertex, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if task.as_py() != now:
                    if len(ids) > 1:
                        yield links(ids, sets)
                    now, ids, sets = task.as_py(), [], []
                ids.append(vertex.as_py())
                sets.append(shingles(words(text.as_py())))
        if len(ids) > 1:
            yield links(ids, sets)

    # The rows of a task are sorted together; a block bounds how many there are.
    n = spread(dealt)
    return dealt.repartition(n, "task").sortWithinPartitions("task", "vertex").mapInArrow(batches, "a bigint, b bigint")


def _block_pairs(places: DataFrame) -> DataFrame:
    """task, vertex for every pair of blocks of a neighbourhood that hold different labels.

    ``places`` has hood, block, vertex, label. A block of one component is not paired with another
    of the same.
    """
    blocks = places.groupBy("hood", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    left, right = (blocks.select("hood", *(F.col(c).alias(f"{c}{i}") for c in ("block", "low", "high"))) for i in (1, 2))
    pairs = left.join(right, "hood").where(
        (F.col("block1") <= F.col("block2"))
        & ~((F.col("low1") == F.col("high1")) & (F.col("low1") == F.col("low2")) & (F.col("low2") == F.col("high2"))))
    pairs = pairs.withColumn("task", F.xxhash64("hood", "block1", "block2"))
    sides = pairs.select("task", "hood", F.explode(F.array_distinct(F.array("block1", "block2"))).alias("block"))
    return places.join(sides, ["hood", "block"]).select("task", "vertex")


def _unsettled_keys(vertices: DataFrame, mixed: DataFrame, labels: DataFrame) -> DataFrame:
    """k, vertex, label, w of the band keys on which different components still meet.

    Of keys with the same vertices one stays.
    """
    labelled = mixed.join(labels.withColumnRenamed("node", "vertex"), "vertex", "left")
    members = vertices.select("vertex", "keys").join(labelled, "vertex").select(
        F.explode("keys").alias("k"), "vertex", "w", F.coalesce("label", "vertex").alias("label"))
    met = members.groupBy("k").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("vertex")).alias("x"), F.sum(F.xxhash64("vertex") % (1 << 31)).alias("y")).where("low <> high")
    once = met.groupBy("n", "x", "y").agg(F.min("k").alias("k")).select("k")
    return members.join(once, "k")


def near_duplicates(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT, block: int = BLOCK,
                    landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (the id is that).

    Texts with fewer than five words have one shingle; null and empty texts have none and are linked
    with nothing; texts are read whole. Rows of equal ids are one vertex, whose links unite. A row
    without an id is linked with nothing: its component is null and it is kept. An empty frame gives
    an empty frame. Other columns are not read.
    """
    signed = stored(_signatures(docs, key, band_width(percent)), "signatures")
    worded = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    vertices = stored(worded.groupBy("words").agg(F.min("doc_id").alias("vertex"), F.first("keys").alias("keys"), F.greatest(
        F.lit(1 / block), F.first("n_shingles") / BLOCK_SHINGLES).alias("w")), "vertices")

    keyed = vertices.select("vertex", F.explode("keys").alias("k"))
    stars = keyed.groupBy("k").agg(F.min("vertex").alias("center"), F.max("vertex").alias("last")).where("center < last")
    hoods = components(keyed.join(stars.select("k", "center"), "k").where("vertex > center").select(
        F.col("vertex").alias("a"), F.col("center").alias("b"))).select(
            F.col("node").alias("vertex"), F.col("label").alias("hood"))
    hoods = stored(hoods.join(vertices.select("vertex", "w"), "vertex"), "neighbourhoods")

    # w: the share of a block that a vertex takes.
    sizes = hoods.groupBy("hood").agg(F.count("*").alias("n"), F.ceil(F.sum("w")).cast("int").alias("blocks"))
    dealt = hoods.join(sizes, "hood").select(
        "vertex", "hood", "blocks", "w",
        F.pmod(F.xxhash64("vertex"), "blocks").cast("int").alias("block"),
        # A landmark is a vertex picked by its hash; there are about ``landmarks`` in a neighbourhood.
        (F.pmod(F.xxhash64(F.lit("mark"), "vertex"), F.ceil(F.col("n") / landmarks)) == 0).alias("mark"))
    texts = docs.select(F.col(key).cast("bigint").alias("vertex"), "text").where("vertex IS NOT NULL")
    # The side without texts grows with the input, so it is never broadcast: one plan for every size.
    dealt = stored(dealt.hint("merge").join(texts, "vertex"), "blocks")

    seen = dealt.withColumn("block", F.explode(F.when(F.col("mark") & (F.col("blocks") > 1), F.sequence(
        F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    seen = seen.select(F.xxhash64("hood", "block").alias("task"), "vertex", "text")
    links = stored(_confirmed(seen, percent), "links")
    repeated = worded.groupBy("doc_id").agg(F.min("words").alias("low"), F.max("words").alias("high")).where("low <> high")
    same_id = worded.join(repeated.select("doc_id"), "doc_id").join(vertices.select("words", "vertex"), "words").select(
        F.col("doc_id").alias("a"), F.col("vertex").alias("b"))
    split = dealt.where("blocks > 1").select("vertex", "text", "w")
    if split.limit(1).count():
        mixed = split.select("vertex", "w").distinct()
        shared = stored(_unsettled_keys(vertices, mixed, components(links)), "unsettled")
        # Of a key: components larger than a block have blocks of their own; the others share blocks.
        by_label = shared.groupBy("k", "label").agg(F.sum("w").alias("m"))
        rest = by_label.where("m <= 1").groupBy("k").agg(F.ceil(F.sum("m")).alias("r"))
        own = F.xxhash64("label", F.pmod(F.xxhash64("vertex"), F.ceil("m")))
        common = F.pmod(F.xxhash64(F.lit("shared"), "label"), F.coalesce("r", F.lit(1)))
        places = shared.join(by_label, ["k", "label"]).join(rest, "k", "left").select(
            F.col("k").alias("hood"), "vertex", "label", F.when(F.col("m") > 1, own).otherwise(common).alias("block"))
        tasks = _block_pairs(stored(places, "places"))
        paired = tasks.join(split.select("vertex", "text"), "vertex").select("task", "vertex", "text")
        links = links.union(stored(_confirmed(paired, percent), "links"))
    groups = components(links.union(same_id)).select(F.col("node").alias("vertex"), "label")
    grouped = vertices.select("words", "vertex").join(groups, "vertex", "left").select(
        "words", F.coalesce("label", "vertex").alias("label"))
    own = signed.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = worded.join(grouped, "words").select("doc_id", "n_shingles", F.col("label").alias("component_id"))
    return own.union(linked).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
