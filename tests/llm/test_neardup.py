import numpy as np
import pytest
from conftest import edited, frame, prose

from corpus_pipeline import near_duplicate_groups
from formpulse.llm import neardup
from formpulse.llm.graphs import components
from formpulse.llm.neardup import near_duplicates, registers, shingles, words


def shingle_set(text):
    found = words(text)
    return {tuple(found[i: i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else {tuple(found)} if found else set()


def groups(rows, percent=85):
    """component by row, by comparing all pairs."""
    ids = sorted({k for k, _ in rows if k is not None})
    parent = {k: k for k in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(k, shingle_set(t)) for k, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return [(k, len(s), None if k is None else find(k) if s else k) for k, s in sets]


def judged(df, **options):
    return sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, **options).collect())))


def near_copies():
    base = [prose(s, 150) for s in range(6)]
    rows = [(10 * s + i, edited(base[s], 100 * s + i, i % 6)) for s in range(6) for i in range(10)]
    rows += [(200 + i, edited(base[0], 900 + i, 2)) for i in range(60)]  # a dense group, many links missing
    rows += [(300 + i, base[1]) for i in range(20)] + [(400 + i, " ".join(base[2].split()[: 3 + i])) for i in range(12)]
    return [*rows, (7, base[5]), (7, "another text of the same id , quite short")]


@pytest.mark.parametrize("block", [1024, 16])
def test_groups_against_all_pairs(spark, block):
    """With small blocks the paths for neighbourhoods that exceed a block are taken."""
    rows = near_copies()
    df = frame(spark, [(k, t, "en", "a") for k, t in rows])
    assert judged(df, block=block, landmarks=4) == sorted(map(repr, groups(rows)))


def test_edge_rows(edge_docs, edge_rows):
    want = groups([(k, t) for k, t, _, _ in edge_rows if k not in (7, 11)])
    got = near_duplicates(edge_docs)
    assert sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in got.collect() if r.doc_id not in (7, 11)))) == sorted(map(repr, want))
    assert {r.kept for r in got.where("doc_id IN (1, 2, 3, 4) OR doc_id IS NULL").collect()} == {True}
    assert judged(edge_docs.limit(0)) == []


def test_words_fold_ascii_only():
    assert words("ÀB c D\x0be\x1cf") == ["Àb".encode(), "c d".encode(), b"e\x1cf"]


def test_registers_hold_the_least_hash_of_each_bucket():
    hashes = np.unique(np.random.default_rng(1).integers(0, 2 ** 64, 3000, dtype=np.uint64))
    got = registers(hashes)
    for bucket in range(neardup.REGISTERS):
        own = [int(h) for h in hashes if (int(h) >> 32) * neardup.REGISTERS >> 32 == bucket]
        scaled = (min(own) >> 32) * neardup.REGISTERS & 0xFFFFFFFF
        place = scaled << 20 | (min(own) & 0xFFFFFFFF) >> 12
        zeros = 52 - place.bit_length()
        mantissa = (place << 53 >> (place.bit_length() - 1 - neardup.MANTISSA + 53)) & (1 << neardup.MANTISSA) - 1
        assert got[bucket] == (zeros + 1) << neardup.MANTISSA | mantissa


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for share in (0.5, 0.8, 0.9):
        for _ in range(30):
            both = rng.integers(0, 2 ** 64, int(1000 * share), dtype=np.uint64)
            alone = [rng.integers(0, 2 ** 64, int(500 * (1 - share)), dtype=np.uint64) for _ in range(2)]
            a, b = (registers(np.unique(np.concatenate([both, x]))) for x in alone)
            true = len(both) / (len(both) + sum(map(len, alone)))
            errors.append(neardup.estimate(((a == b) & (a > 0)).sum(), ((a | b) > 0).sum()) - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (5, 5), (200, 201), (201, 202), (202, 200)]
    got = dict(components(spark.createDataFrame([*edges, (None, 1)], "a bigint, b bigint")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_shingles_of_short_texts():
    assert [len(shingles(words(t))) for t in (None, "", "a", "a b c d", "a b c d e", "a b c d e f", "a a a a a a a")] == [0, 0, 1, 1, 1, 2, 1]


def similar_pair(at, low, high):
    """A text, and a copy with edits whose similarity lies between the bounds."""
    base = prose(at, 260)
    for trial in range(400):
        copy = edited(base, 1000 * at + trial, 2 + trial % 20)
        x, y = shingle_set(base), shingle_set(copy)
        if low <= len(x & y) / len(x | y) < high:
            return base, copy
    raise AssertionError("no such pair")


def test_stage_links_pairs_between_80_and_85(spark):
    """The stage of the pipeline keeps one of each pair at 0.81 to 0.84; op7 keeps both."""
    pairs = [similar_pair(2000 + i, 0.81, 0.84) for i in range(25)] + [similar_pair(3000, 0.72, 0.79)]
    df = frame(spark, [(2 * i + k, text, "en", "a") for i, pair in enumerate(pairs) for k, text in enumerate(pair)])
    kept = {r.doc_id for r in near_duplicate_groups(spark, df, "").collect()}
    assert kept == {*range(0, 52, 2), 51}
    assert {r.doc_id for r in near_duplicates(df).where("kept").collect()} == set(range(52))


def test_bands_and_margin_follow_the_similarity():
    assert [(neardup.band_width(p), neardup.margin(p)) for p in (85, 80)] == [(6, 0.13), (5, 0.15)]
    for p in (95, 85, 80, 70):
        width = neardup.band_width(p)
        assert (1 - (p / 100) ** width) ** (neardup.REGISTERS // width) <= neardup.MISSED
