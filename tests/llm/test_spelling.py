"""Near words, forms and roots against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest import frame, prose

from formpulse.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def words_of(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def expected(words):
    near = {w: [u for u in words if one_edit(w, u)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda u: (-words[u], u), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words[form[w]] if form[w] else -1) for w in words)


def result(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def counted(spark, words):
    return spark.createDataFrame(sorted(words.items()), "word string, n bigint")


def pairs(spark, words):
    found = spelling.near_words(counted(spark, words)).collect()
    return sorted(tuple(sorted((r.word, r.other))) for r in found)


@pytest.mark.parametrize("seed", range(3))
def test_dense_words(spark, seed):
    """Few letters, so that every kind of edit, runs of equal letters and words within words are common."""
    pick = random.Random(seed)
    words = {"".join(pick.choice("abé"[:2 + seed % 2]) for _ in range(pick.randint(5, 9))): pick.randint(3, 40) for _ in range(400)}
    words |= {"a" * n: n for n in range(5, 14)}
    assert pairs(spark, words) == sorted(
        (a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_long_words(spark):
    """Words of many thousand letters: edits at both ends, in the middle, within a run."""
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(30_000))
    words = {long: 9, long[:-1]: 3, long[1:]: 3, long[:15_000] + "z" + long[15_001:]: 4, long[:99] + long[100:]: 5,
             "x" * 30_000: 3, "x" * 29_999: 4, "x" * 29_997: 5, long + "zz": 3}
    assert pairs(spark, words) == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_hot_prefix(spark):
    """Most words share their first letters."""
    pick = random.Random(7)
    words = {"anticipat" + "".join(pick.choice("xyz") for _ in range(pick.randint(1, 5))): 3 for _ in range(250)}
    words |= {"".join(pick.choice("xyz") for _ in range(pick.randint(1, 5))) + "ization": 3 for _ in range(250)}
    assert pairs(spark, words) == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_chain_of_forms(spark):
    """Forms of forms, and ties that the smaller word wins."""
    words = {"aaaaaa": 3, "aaaaab": 6, "aaaabb": 12, "aaabbb": 24, "aabbbb": 48, "abbbbb": 96, "cccccc": 5, "cccccd": 10,
             "ccccce": 10, "cccccf": 9, "zzzzzz": 4, "zzzzzy": 7}
    near = spelling.near_words(counted(spark, words))
    found = spelling.forms(counted(spark, words), near)
    out = found.join(spelling.roots(found), "word", "left").fillna({"root": "-"}).collect()
    got = {r.word: (r.form, r.root) for r in out}
    assert got["aaaaaa"] == ("aaaaab", "abbbbb") and got["abbbbb"] == (None, "-")
    assert got["cccccc"] == ("cccccd", "cccccd") and got["zzzzzz"] == (None, "-")


def test_query(spark, tmp_path, edge_rows, monkeypatch):
    """Whole operator on edge rows and prose whose words are many, with runs that lose a letter."""
    extra = [(1000 + i, prose(i % 40, 200) + " ÀÉÎ×÷ÿ Straße's ABBA co-operate", "en", "a") for i in range(120)]
    rows = [*edge_rows, *extra]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = spelling.op12_spelling(spark, str(tmp_path))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    words = words_of(rows)
    found = result(out)
    assert len(words) > 300 and found == expected(words)
    assert any(form for _, form, *_ in found)


def test_counts_handed_on_early(spark, monkeypatch, edge_docs, edge_rows):
    whole = {r.word: r.n for r in spelling.word_counts(edge_docs).collect()}
    assert whole == words_of(edge_rows)


def test_empty_table(spark, tmp_path):
    frame(spark, [(1, None, None, None), (2, "no", "en", "a")]).write.parquet(str(tmp_path / "documents.parquet"))
    assert spelling.op12_spelling(spark, str(tmp_path)).collect() == []
