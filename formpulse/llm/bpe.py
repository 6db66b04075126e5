"""Byte-level BPE: texts to token ids and back, merges found by a segment tree.

A text is cut into matches of the vocabulary's pattern, and each match is merged on its own. The tree's
leaves are the byte positions of the match; a leaf holds the rank of the pair that begins there, if that
position begins a live part and the pair is in the vocabulary. Inner nodes hold the least of their
leaves, the leftmost among equals, so the root names the next merge. A merge changes the pairs of two
live neighbours at most and empties one leaf: three point updates of logarithmic cost each, so a match
of n bytes takes n log n steps, however long it is. Short matches have their trees side by side in one
array, and a step makes the next merge of each of them.

Rows never meet, so there is no shuffle. A task holds one Arrow batch, the vocabulary, and the ids of a
bounded number of short matches met before.

Null and empty texts have no ids. Repeated rows are encoded each; other columns pass through, whatever
their names. Ids that are not in the vocabulary stop the decoding; null ids are null bytes.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Texts kept with their ids in each worker, and the longest of them, in characters.
REMEMBERED, SHORT = 500_000, 64
#: Bytes of the matches whose trees stand side by side, and how many of them at a time.
NARROW, TREES = 32, 8192
#: White space next to a blank, where a match may hold both.
_RUN = re.compile(r" \s|\s \Z")
#: Bytes of text, or ids, that are taken on at a time.
PART = 2_000_000


def read_ranks(file: str) -> dict[bytes, int]:
    """A vocabulary file of lines "base64 rank"."""
    with open(file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: No pair begins here.
NONE = 1 << 62


def pair_tree(ranks: list[int | None]) -> list[int]:
    """The least pair rank over the positions of one match, the leftmost among equals.

    Node i has the children 2 i and 2 i + 1, the leaves stand in the second half. A node holds
    rank * leaves + position, so that the least number is the leftmost of the least rank.
    """
    size = 1 << (len(ranks) - 1).bit_length()
    tree = [NONE] * (2 * size)
    for i, rank in enumerate(ranks):
        if rank is not None:
            tree[size + i] = rank * size + i
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    return tree


def climb(tree: list[int], a: int, b: int, c: int) -> None:
    """Bring the ancestors of three leaves, given in order, up to date; paths that meet are climbed once."""
    a, b, c = a >> 1, b >> 1, c >> 1
    while a != c:
        left, right = tree[2 * a], tree[2 * a + 1]
        tree[a] = left if left < right else right
        if b != a:
            left, right = tree[2 * b], tree[2 * b + 1]
            tree[b] = left if left < right else right
        if c != b:
            left, right = tree[2 * c], tree[2 * c + 1]
            tree[c] = left if left < right else right
        a, b, c = a >> 1, b >> 1, c >> 1
    while a:
        left, right = tree[2 * a], tree[2 * a + 1]
        tree[a] = left if left < right else right
        a >>= 1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: its own if it is a token, else those of the parts that no merge joins."""
    rank = ranks.get
    whole = rank(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    # A live part begins at i and ends before following[i]; before[i] begins the part to its left.
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = pair_tree([rank(piece[i:i + 2]) for i in range(n - 1)] + [None])
    size = len(tree) // 2
    while (top := tree[1]) != NONE:
        at = top % size
        gone, left = following[at], before[at]
        following[at] = end = following[gone]
        first = here = size + at
        if end < n:
            before[end] = at
            joined = rank(piece[at:following[end]])
            tree[here] = NONE if joined is None else joined * size + at
        else:
            tree[here] = NONE
        if left >= 0:
            joined = rank(piece[left:end])
            first = size + left
            tree[first] = NONE if joined is None else joined * size + left
        tree[size + gone] = NONE
        climb(tree, first, here, size + gone)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at:following[at]]])
        at = following[at]
    return out


class Pairs:
    """Ranks of joined pairs of tokens, looked up for many pairs at once. All bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        rank = ranks.get
        found = [(a, b, whole) for token, whole in ranks.items() for i in range(1, len(token))
                 if (a := rank(token[:i])) is not None and (b := rank(token[i:])) is not None]
        left, right, whole = np.array(found, np.int64).reshape(-1, 3).T
        self.n = max(ranks.values()) + 1
        keys = left * self.n + right
        order = np.argsort(keys)
        # The last key is larger than any pair's.
        self.keys, self.ranks = np.append(keys[order], self.n * self.n), np.append(whole[order], 0)
        self.bytes = np.array([ranks[bytes([x])] for x in range(256)], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of the joined pairs, and which of them are tokens."""
        keys = left * self.n + right
        at = np.searchsorted(self.keys, keys)
        return self.ranks[at], self.keys[at] == keys


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """Ids of matches of two bytes at least, as 32-bit numbers, merged side by side.

    Each column holds one match: its tree of ``pair_tree``, the tokens of its parts by their first
    places, and the parts' neighbours as in ``merge``.
    """
    m, lengths = len(pieces), np.array([len(piece) for piece in pieces])
    size = 1 << (int(lengths.max()) - 1).bit_length()
    packed = np.frombuffer(b"".join([piece.ljust(size, b"\0") for piece in pieces]), np.uint8)
    places = np.arange(size)[:, None]
    tokens = pairs.bytes[packed.reshape(m, size).T]
    tree = np.full((2 * size, m), NONE)
    joined, known = pairs(tokens[:-1], tokens[1:])
    tree[size:-1] = np.where(known & (places[1:] < lengths), joined * size + places[:-1], NONE)
    low = size
    while low > 1:
        tree[low // 2:low] = np.minimum(tree[low:2 * low:2], tree[low + 1:2 * low:2])
        low //= 2
    following, before = (np.repeat(first + np.arange(size + 1), m) for first in (1, -1))
    live = (places < lengths).ravel()
    tree, tokens = tree.ravel(), tokens.ravel()
    columns = np.arange(m)
    while len(columns := columns[tree[m + columns] != NONE]):
        whole, at = np.divmod(tree[m + columns], size)
        here = at * m + columns
        gone, left = following[here], before[here]
        following[here] = end = following[gone * m + columns]
        before[end * m + columns] = at
        tokens[here] = whole
        live[gone * m + columns] = False
        # A match's first part has no neighbour to its left, its last none to its right: those leaves stay empty.
        inner = left >= 0
        first = np.where(inner, left, at)
        joined, known = pairs(tokens[first * m + columns], whole)
        tree[(size + first) * m + columns] = np.where(known, joined * size + first, NONE)
        inside = end < lengths[columns]
        joined, known = pairs(whole, tokens[np.where(inside, end, at) * m + columns])
        tree[(size + at) * m + columns] = np.where(known & inside, joined * size + at, NONE)
        tree[(size + gone) * m + columns] = NONE
        nodes = [size + first, size + at, size + gone]
        for _ in range(size.bit_length() - 1):
            nodes = [node >> 1 for node in nodes]
            for node in nodes:
                child = 2 * node * m + columns
                tree[node * m + columns] = np.minimum(tree[child], tree[child + m])
    live = live.reshape(size, m).T
    ids = tokens.reshape(size, m).T[live].astype(np.int32).tobytes()
    ends = [0, *(4 * np.cumsum(live.sum(1))).tolist()]
    return [ids[a:b] for a, b in zip(ends, ends[1:])]


class Codec:
    """Ids of texts under one vocabulary and pattern, and their bytes.

    ``blanks`` says that no match of the pattern holds a single blank but at its start, so that texts may
    be cut before each blank that stands alone.
    """

    def __init__(self, file: str, pattern: str, blanks: bool):
        self.ranks = read_ranks(file)
        by_rank = {rank: token for token, rank in self.ranks.items()}
        if sorted(by_rank) != list(range(len(by_rank))):
            raise ValueError("ranks have gaps")
        self.tokens = pa.array([by_rank[rank] for rank in range(len(by_rank))], pa.binary())
        self.find = regex.compile(pattern).findall
        self.blanks = blanks
        self.pairs = Pairs(self.ranks) if all(bytes([x]) in self.ranks for x in range(256)) else None
        #: Ids of pieces and matches as 32-bit numbers.
        self.met: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        """The text in pieces of whole matches."""
        if not self.blanks or _RUN.search(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first, *[" " + piece for piece in rest]] if first else [" " + piece for piece in rest]

    def _meet(self, matches: set[str]) -> None:
        """Take the ids of matches not met before into ``met``."""
        met, rank, by_size = self.met, self.ranks.get, {}
        for match in matches:
            piece = match.encode()
            whole = rank(piece)
            if whole is not None:
                met[match] = array("i", [whole]).tobytes()
            elif self.pairs is None or len(piece) > NARROW:
                met[match] = array("i", merge(piece, self.ranks)).tobytes()
            else:
                by_size.setdefault((len(piece) - 1).bit_length(), []).append((match, piece))
        for found in by_size.values():
            for start in range(0, len(found), TREES):
                part = found[start:start + TREES]
                met.update(zip([match for match, _ in part], merge_many([piece for _, piece in part], self.pairs)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers; equal pieces of the texts are matched and merged once."""
        met = self.met
        if len(met) > REMEMBERED:
            met.clear()
        cut = [self._pieces(text) for text in texts]
        new = set().union(*cut).difference(met)
        matches = {piece: self.find(piece) for piece in new}
        unmet = set().union(*matches.values()).difference(met)
        self._meet(unmet)
        for piece, found in matches.items():
            met[piece] = b"".join([met[match] for match in found])
        out = [b"".join(map(met.__getitem__, pieces)) for pieces in cut]
        for long in [text for text in new | unmet if len(text) > SHORT]:
            del met[long]
        return out

    def decode(self, ids: pa.ListArray) -> pa.BinaryArray:
        """Bytes of each list: the tokens' bytes, one after the other, with the lists' own ends."""
        values = ids.flatten()
        if values.null_count or (len(values) and not 0 <= pc.min(values).as_py() <= pc.max(values).as_py() < len(self.tokens)):
            raise ValueError("ids are not in the vocabulary")
        tokens = self.tokens.take(values)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
        starts = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset:tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int32)
        offsets = pa.py_buffer(np.ascontiguousarray(starts[ends], np.int32).tobytes())
        whole = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, offsets, tokens.buffers()[2] or pa.py_buffer(b"")])
        return pc.if_else(ids.is_valid(), whole, pa.scalar(None, pa.binary())) if ids.null_count else whole


@lru_cache(maxsize=2)
def codec(file: str, pattern: str) -> Codec:
    """One codec for each worker, file and pattern."""
    import public_tokenizers

    return Codec(file, pattern, pattern == public_tokenizers.PATTERN)


def _cut(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose values in one column are long together at one row only."""
    for batch in batches:
        lengths = pc.fill_null(pc.cast(_length(batch.column(batch.schema.get_field_index(name))), pa.int64()), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False)) // PART
        starts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(starts, starts[1:]) if b > a)


def _length(column: pa.Array) -> pa.Array:
    return pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def encode(df: DataFrame, file: str, pattern: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with the token ids of ``text`` in a new column of integers (none for null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file, pattern)
        for batch in _cut(batches, text):
            values = own.encode([value or "" for value in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            offsets = array("i", [0])
            for packed in values:
                offsets.append(offsets[-1] + len(packed) // 4)
            flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(values))])
            yield _with(batch, ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, file: str, pattern: str, *, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """The rows with the bytes that the ids stand for in a new column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file, pattern)
        for batch in _cut(batches, ids):
            yield _with(batch, out, own.decode(batch.column(batch.schema.get_field_index(ids))))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def op13_bpe(spark: SparkSession, sf_dir: str, *, file: str | None = None) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    import public_tokenizers

    file, pattern = file or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), file, pattern).drop("text")
    decoded = decode(encoded, file, pattern)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
