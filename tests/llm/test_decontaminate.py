import random

import pytest
from conftest import edited, frame, prose

from corpus_pipeline import decontamination
from formpulse.llm.decontaminate import (
    CHUNK,
    LEAST,
    NARROW,
    STEP,
    Index,
    bound,
    contaminated,
    distance,
    edits,
    normal,
    op6_decontaminate,
    windows,
)


def nearest(window, text):
    """Edits between a window and the nearest part of a text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (c != t)))
        row = now
    return min(row)


def scratched(text: bytes, n: int, seed: int) -> bytes:
    pick, out = random.Random(seed), bytearray(text)
    for _ in range(n):
        at = pick.randrange(len(out))
        kind = pick.randrange(3)
        if kind == 0:
            out[at] = pick.randrange(97, 123)
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, pick.randrange(97, 123))
    return bytes(out)


@pytest.mark.parametrize("n", range(0, 14))
def test_filter_and_alignment_against_full_alignment(n):
    items = [(i, w) for i in range(6) for w in windows(normal(prose(i, 70)))]
    index = Index(items)
    for seed in range(4):
        which = (seed + n) % len(items)
        text = normal(prose(900 + seed, 40)) + b" " + scratched(items[which][1], n, seed) + b" " + normal(prose(700 + seed, 30))
        best = {}
        for item, w in items:
            d = nearest(w, text)
            if d <= edits(len(w)):
                best[item] = min(d, best.get(item, d))
        assert index.matches(text) == best


def test_distance_within_the_budget():
    pick = random.Random(3)
    for seed in range(60):
        window = normal(prose(seed, 12))[:60]
        text = scratched(window, pick.randrange(8), seed)
        true = nearest(window, text)
        assert distance(window, text, 4) == min(true, 5)


def test_lemma_bound():
    assert bound(160) == 160 + 1 - 12 * 9 and bound(40) == 5 and min(map(bound, range(LEAST, 400))) >= 1


def test_matches_across_chunks():
    item = normal(prose(1, 60))
    index = Index([(1, w) for w in windows(item)])
    for shift in (-200, -90, -1, 0, 50):
        filler = (normal(prose(2, 20_000)) * 2)[: CHUNK + shift]
        assert index.matches(filler + b" " + item + b" tail")[1] == 0


def test_rows(spark, edge_docs, edge_rows):
    bench = spark.createDataFrame(
        [(1, prose(11, 45)), (2, edge_rows[4][1]), (3, None), (4, ""), (5, "short"), (None, prose(13, 45)), (2, prose(14, 45))],
        "item_id bigint, text string")
    docs = [(100, prose(50, 30) + "\n" + prose(11, 45).upper().replace(" ", "  ") + " more", "en", "a"), (101, edited(prose(13, 45), 1, 0), "en", "a"),
            (102, "x " + prose(14, 45), "en", "a"), (103, prose(11, 45)[:120], "en", "a")]
    df = frame(spark, docs).unionByName(edge_docs)
    for size in (2_000_000, 300):  # one block, and several
        got = contaminated(df, bench, block_bytes=size)
        assert got.columns == [*df.columns, "__items"]
        rows = got.collect()
        assert len(rows) == len(docs) + len(edge_rows)
        found = {repr((r["doc_id"], r["lang"], r["source"])): [x.item_id for x in r["__items"]] for r in rows if r["__items"]}
        assert {k: v for k, v in found.items() if k.startswith("(10") and k[1:4] != "10,"} == {
            "(100, 'en', 'a')": [1], "(101, 'en', 'a')": [None], "(102, 'en', 'a')": [2], "(103, 'en', 'a')": [1]}
        assert found["(5, 'en', 'a')"] == [2] and found["(6, 'en', 'b')"] == [2] and found["(None, None, None)"] == [2]
        assert not any(k.startswith(("(1,", "(2,", "(3,", "(4,", "(8,", "(10,", "(12,")) for k in found)
    assert contaminated(edge_docs.limit(0), bench).collect() == []
    assert all(not r["__items"] for r in contaminated(edge_docs, bench.limit(0)).collect())


def test_every_excerpt_of_80_bytes_is_found():
    item, around = normal(prose(21, 60)), (normal(prose(22, 30)), normal(prose(23, 30)))
    index = Index([(1, w) for w in windows(item, NARROW, STEP)])
    assert NARROW + STEP - 1 == 80 and len(item) > 200
    for start in range(len(item) - 79):
        assert index.matches(around[0] + b" " + item[start: start + 80] + b" " + around[1]) == {1: 0}
    assert index.matches(b" ".join(around)) == {}


def test_short_texts_match_on_word_borders():
    index = Index([(1, b"two plus two"), (2, "naïve?".encode()), (3, b"?!"), (4, b'"so" he said'), (None, b"seven")])
    for text, want in (
            ("is two plus two, four", {1}), ("two plus twofold", set()), ("into two plus two", {1}), ("stwo plus two", set()),
            ("two plus\ntwo", {1}), ("so naïve? yes", {2}), ("naïveté? naïve!", set()), ("what ?! now", {3}), ("what?!", set()),
            ('and "so" he said.', {4}), ("seventy", set()), ("seven", {None}), ("", set())):
        assert set(index.matches(normal(text))) == want


def test_query_and_stage_find_excerpts_and_short_texts(spark, tmp_path):
    item = prose(31, 45)
    at = len(item) // 3
    docs = frame(spark, [(1, f"{prose(32, 40)} {item[at: at + 90]} {prose(33, 40)}", "en", "a"), (2, prose(34, 80), "en", "a"),
                         (3, f"{prose(35, 20)} What is up, doc? {prose(36, 20)}", "en", "a"), (4, None, "en", "a")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item), (8, "what is up, doc?")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.doc_id: r["items"] for r in op6_decontaminate(spark, str(tmp_path)).collect()} == {1: "7:0", 2: "", 3: "8:0", 4: ""}
    assert {r.doc_id for r in decontamination(spark, docs, str(tmp_path)).collect()} == {2, 4}
