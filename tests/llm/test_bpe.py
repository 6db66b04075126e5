"""The segment tree against the public library on the same ranks, and exact round trips."""

import base64
import hashlib
import random

import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken
from conftest import frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from formpulse.llm import bpe

FILE = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(FILE), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.codec(FILE, public.PATTERN)


def ids(codec, text):
    return list(memoryview(codec.encode([text])[0]).cast("i"))


def plain_merge(piece, ranks):
    """Merge the leftmost pair of least rank until none is left."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not known:
            return [ranks[p] for p in parts]
        _, i = min(known)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=24), st.integers(0, 10 ** 6))
def test_merges_of_any_ranks(piece, seed):
    """Few letters and random ranks, so that ties, runs and dead ends are common."""
    piece, pick = bytes(b"abc"[x % 3] for x in piece), random.Random(seed)
    grown = [b"a", b"b", b"c"]
    grown += [pick.choice(grown) + pick.choice(grown[:9]) for _ in range(40)]
    tokens = list(dict.fromkeys(grown))
    ranks = {t: i for i, t in enumerate(tokens)}
    found = bpe.merge(piece, ranks)
    assert found == ([ranks[piece]] if piece in ranks else plain_merge(piece, ranks))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=2, max_size=24), min_size=1, max_size=12), st.integers(0, 10 ** 6))
def test_merges_side_by_side(pieces, seed):
    """Matches of different lengths and numbers of merges in one array."""
    pieces, pick = [bytes(b"abc"[x % 3] for x in piece) for piece in pieces], random.Random(seed)
    grown = [b"a", b"b", b"c"]
    grown += [pick.choice(grown) + pick.choice(grown[:9]) for _ in range(40)]
    tokens = list(dict.fromkeys([*grown, *(bytes([x]) for x in range(256))]))
    pick.shuffle(tokens)
    ranks = {t: i for i, t in enumerate(tokens)}
    found = [list(memoryview(ids).cast("i")) for ids in bpe.merge_many(pieces, bpe.Pairs(ranks))]
    assert found == [plain_merge(piece, ranks) for piece in pieces]


def test_short_matches_are_merged_together(monkeypatch, reference):
    """One by one only the long ones; more matches than stand side by side at a time."""
    alone, merge = [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda piece, ranks: alone.append(piece) or merge(piece, ranks))
    monkeypatch.setattr(bpe, "TREES", 7)
    small = bpe.Codec(FILE, public.PATTERN, True)
    text = " ".join(f"{word}qz{i}x" for i, word in enumerate(prose(9, 300).split())) + " " + "zq" * 40 + ", é\u4e2d🙂!?\x1c"
    assert ids(small, text) == reference.encode_ordinary(text)
    assert alone == [b" " + b"zq" * 40] and max(map(len, small.met)) <= bpe.SHORT


def test_vocabulary_without_all_bytes(tmp_path):
    tokens = [b"a", b"b", b"ab", b"aba"]
    (tmp_path / "few").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    few = bpe.Codec(str(tmp_path / "few"), "[ab]+", False)
    assert ids(few, "abab") == [2, 2] and ids(few, "aba bab") == [3, 1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 5)), min_size=1, max_size=20),
       st.lists(st.tuples(st.integers(0, 19), st.one_of(st.none(), st.integers(0, 5))), max_size=30))
def test_tree_holds_the_leftmost_least(ranks, updates):
    tree = bpe.pair_tree(ranks)
    size = len(tree) // 2
    for at, rank in [(0, ranks[0]), *updates]:
        changed = [i for i in (at, at + 1 + at % 3, at + 2 + at % 5) if i < len(ranks)]
        for i in changed:
            ranks[i] = rank
            tree[size + i] = bpe.NONE if rank is None else rank * size + i
        if changed:
            bpe.climb(tree, size + changed[0], size + changed[len(changed) // 2], size + changed[-1])
        least = min(((r * size + i) for i, r in enumerate(ranks) if r is not None), default=bpe.NONE)
        assert tree[1] == least


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("    \n\t'sret中é🙂1\x1c\x85\u2028\xa0")), max_size=200))
def test_same_ids_as_the_library(own, reference, text):
    found = ids(own, text)
    assert found == reference.encode_ordinary(text)
    assert own.decode(pa.array([None, found, [], found], pa.list_(pa.int32()))).to_pylist() == [None, text.encode(), b"", text.encode()]


@pytest.mark.parametrize("text", [
    "a" * 70_000, "é" * 20_000, "ab" * 30_000, " " * 5000 + "x", "\n" * 3000, "9" * 10_000, prose(5, 20_000), "<|endoftext|>", " ", "  ", "a ", "a \n", "a\n ", "\n a", " \n  a b  c "])
def test_long_matches(own, reference, text):
    assert ids(own, text) == reference.encode_ordinary(text)


def test_forgetting(monkeypatch, reference):
    """More different words than are kept, met again and again."""
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    small = bpe.Codec(FILE, public.PATTERN, True)
    for seed in (1, 2, 1, 3, 2):
        text = prose(seed, 300) + " " + "y" * 100
        assert ids(small, text) == reference.encode_ordinary(text) and max(map(len, small.met)) <= 100


def test_frames(spark, edge_docs, edge_rows, reference):
    """Nulls, empty and long texts, repeated rows, and columns with names of the operator's own."""
    docs = edge_docs.withColumnRenamed("ids", "ids_")
    out = bpe.decode(bpe.encode(docs, FILE, public.PATTERN), FILE, public.PATTERN, out="raw")
    assert out.columns == [*docs.columns, "ids", "raw"]
    rows = out.select("doc_id", "text", "ids", "raw").collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((r[0], r[1]) for r in edge_rows), key=repr)
    for r in rows:
        assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.raw) == (r.text or "").encode()


def test_foreign_ids(own):
    for bad in ([-1], [50256], [1, None]):
        with pytest.raises(ValueError, match="vocabulary"):
            own.decode(pa.array([[5], bad], pa.list_(pa.int32())))
    sliced = pa.array([[1], [2, 3], None, [4]], pa.list_(pa.int32())).slice(1)
    token = {rank: t for t, rank in own.ranks.items()}
    assert own.decode(sliced).to_pylist() == [token[2] + token[3], None, token[4]]


def test_parts(monkeypatch):
    """Rows are taken on in parts without being lost."""
    monkeypatch.setattr(bpe, "PART", 3)
    batch = pa.RecordBatch.from_pydict({"a": list(range(8)), "text": [*("x" * n for n in range(7)), None]})
    for name, column in (("text", batch.column(1)), ("ids", pa.array([*([1] * n for n in range(7)), None]))):
        batch = pa.RecordBatch.from_arrays([batch.column(0), column], names=["a", name])
        parts = list(bpe._cut([batch, batch.slice(0, 0)], name))
        assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict() and len(parts) == 6


def test_query(spark, tmp_path, edge_rows, reference):
    frame(spark, edge_rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = bpe.op13_bpe(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for doc_id, text, *_ in edge_rows:
        tokens = reference.encode_ordinary(text or "")
        expected.append((doc_id, len(tokens), sha(" ".join(map(str, tokens)).encode()), sha((text or "").encode())))
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, expected))


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert bpe.op13_bpe(spark, str(tmp_path)).collect() == []
