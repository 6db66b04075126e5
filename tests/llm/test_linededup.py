import random

import pytest
from conftest import frame, prose
from pyspark.sql import functions as F

from formpulse.llm.linededup import dedup_lines, masked, parse, without_lines


def tree(rows, depth=3, similar=0.8, least=5, documents=3):
    """The lines dropped from each row, by a plain tree over distinct rows."""
    leaves, found = {}, {}
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for key, text in distinct:
        for number, line in enumerate((text or "").split("\n")):
            words = masked(line.encode())
            if len(words) - words.count(b"<*>") >= least:
                leaves.setdefault((len(words), *words[:depth]), {}).setdefault(tuple(words), []).append((key, text, number))
    for entries in leaves.values():
        templates = []
        for words, places in entries.items():
            for t in templates:
                if sum(a == b for a, b in zip(t[0], words, strict=True)) >= similar * len(words):
                    t[0] = [a if a == b else b"<*>" for a, b in zip(t[0], words, strict=True)]
                    t[1].extend(places)
                    break
            else:
                templates.append([list(words), list(places)])
        for _, places in templates:
            if len({p[:2] for p in places}) >= documents:
                first = min(places, key=lambda p: (p[0] is not None, p[0] or 0, p[2]))
                for key, text, number in places:
                    if (key, text, number) != first:
                        found.setdefault((key, text), set()).add(number)
    return [(k, t, sorted(found.get((k, t), ()))) for k, t in rows]


NOTICE = "Access from host {} was granted to the user of section {}"
ROWS = [
    *((i, f"{prose(i, 30)}\n{NOTICE.format(f'h{i}', f'b{i % 2}')}\n{prose(50 + i, 20)}") for i in range(1, 8)),
    (20, "The same long line of many words stands here\nother"), (21, "The same long line of many words stands here"),
    (22, "x\nThe same long line of many words stands here\nThe same long line of many words stands here"),
    (22, "x\nThe same long line of many words stands here\nThe same long line of many words stands here"),
    (30, "short line\nshort line"), (31, "short line"), (32, "short line"),
    (40, "only two documents hold this line of words"), (41, "only two documents hold this line of words"),
    (50, None), (51, ""), (52, "\n\n"), (None, "The same long line of many words stands here"),
    (60, "the quick red fox jumps over the lazy dog today"), (61, "the quick red cat jumps over the lazy dog today"),
    (62, "the quick red fox jumps over the lazy cow today"), (63, "the quick red fox sleeps under some other old tree"),
]


@pytest.mark.parametrize("block", [2000, 16, 1])
def test_dropped_lines(spark, block):
    """With blocks of one entry, groups meet in the second pass only."""
    df = frame(spark, [(k, t, "en", "a") for k, t in ROWS])
    got = [
        (r["doc_id"], r["text"], list(r["__dropped"] or ())) for r in dedup_lines(df, block=block).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, tree(ROWS)))


@pytest.mark.parametrize(("others", "block"), [(30, 2000), (1500, 40), (1500, 7)])
def test_families_in_large_leaves(spark, others, block):
    """Families of four lines that differ in one word, at any place, among many other lines of a leaf."""
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("bdfgklmnprst") + pick.choice("aeiou") for _ in range(4))
    rows, families = [], 40
    for family in range(families):
        tail = [word() for _ in range(7)]
        for variant in range(4):
            line = [*tail]
            line[family % 7] = word()
            rows.append((family * 10 + variant, " ".join(["all", "lines", "begin", *line])))
    rows += [(100_000 + i, " ".join(["all", "lines", "begin", *(word() for _ in range(7))])) for i in range(others)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    dropped = sorted(r.doc_id for r in dedup_lines(df, block=block).collect() if r["__dropped"])
    assert dropped == sorted(family * 10 + variant for family in range(families) for variant in (1, 2, 3))


def test_variable_fields_become_wildcards():
    groups, templates = parse([b"a b c d e f g h i j".split(), b"a b c d e x g h i j".split(), b"a b q r s t u v w z".split()], 0.8)
    assert groups == [0, 0, 1] and templates[0] == b"a b c d e <*> g h i j".split()
    assert masked(b"error 17 at 0x3f now") == [b"error", b"<*>", b"at", b"<*>", b"now"]


def test_texts_keep_their_other_lines(spark):
    df = spark.createDataFrame([("a\nb\nc\n", [1]), ("a", None), ("a\nb", [0, 1])], "text string, d array<int>")
    assert [r[0] for r in df.select(without_lines(F.col("text"), F.col("d"))).collect()] == ["a\nc\n", "a", ""]


def test_edge_rows(edge_docs, edge_rows):
    got = dedup_lines(edge_docs)
    assert got.columns == [*edge_docs.columns, "__dropped"]
    rows = [(k, t) for k, t, _, _ in edge_rows]
    assert sorted(repr((r["doc_id"], list(r["__dropped"] or ()))) for r in got.collect()) == sorted(repr((k, d)) for k, _, d in tree(rows))
    assert dedup_lines(edge_docs.limit(0)).collect() == []
