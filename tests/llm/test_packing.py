import zlib

import numpy as np
import public_tokenizers
from conftest import frame
from tokenizers import Tokenizer

from formpulse.llm.packing import Mixture, pack


def encoded(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_each_token_lies_in_one_piece_and_sequences_are_full(edge_docs, edge_rows):
    pieces = pack(edge_docs, window=4096).collect()
    want = [encoded(t) for _, t, _, _ in edge_rows]
    total = sum(map(len, want))
    places = sorted((p.sequence_id * 1024 + p.offset, p.length) for p in pieces)
    assert [a for a, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) == total
    assert all(p.offset + p.length <= 1024 for p in pieces)
    for key, text, _, _ in edge_rows:
        ids = np.array(encoded(text), "<u4")
        own = [p for p in pieces if p.doc_id == key and p.doc_tokens == len(ids)]
        for p in own:
            assert p.ids == ids[p.start: p.start + p.length].tobytes() and p.ids_crc32 == zlib.crc32(p.ids) or key in (None, 11)
        copies = sum(1 for k, t, _, _ in edge_rows if k == key and len(encoded(t)) == len(ids))
        assert sum(p.length for p in own) == copies * len(ids)


def test_windows_hold_the_target_mixture(spark):
    rows = [(i, "word " * (5 + i % 50), "en", "abc"[i % 3 if i % 2 else 0]) for i in range(3000)]
    pieces = pack(frame(spark, rows), window=8192).toPandas()
    by_window = pieces.pivot_table(index="window", columns="source", values="length", aggfunc="sum")
    share = pieces.groupby("source").length.sum() / pieces.length.sum()
    assert len(by_window) > 5
    assert (by_window.sub(by_window.sum(axis=1), axis=0).add(by_window.sum(axis=1), axis=0).div(by_window.sum(axis=1), axis=0) - share).abs().max().max() < 2 / 8000 * 2


def test_mixture_against_token_by_token():
    mixture = Mixture([7, 0, 20, 13], window=9)
    stream, served = {}, [0] * 4
    place = 0
    for w in range(mixture.windows):
        for q, n in enumerate([7, 0, 20, 13]):
            while served[q] < (w + 1) * n // mixture.windows:
                stream[q, served[q]] = (place, w)
                served[q] += 1
                place += 1
    assert place == 40
    for q, n in enumerate([7, 0, 20, 13]):
        for start, count, at, w in mixture.pieces(q, 0, n, 5) if n else ():
            assert at // 5 == (at + count - 1) // 5
            for k in range(count):
                assert stream[q, start + k] == (at + k, w)


def test_counts_beyond_64_bits_of_products():
    mixture = Mixture([10 ** 13, 3 * 10 ** 12], window=65536)
    token = 9_876_543_210_987
    (_, _, place, w), *_ = mixture.pieces(0, token, 1, 1024)
    assert w * 10 ** 13 // mixture.windows <= token < (w + 1) * 10 ** 13 // mixture.windows
    assert abs(place / (1.3 * 10 ** 13) - token / 10 ** 13) < 1e-6


def test_empty(edge_docs):
    assert pack(edge_docs.limit(0)).collect() == []
