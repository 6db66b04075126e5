"""Licences and urls against their SQL twins on difficult rows, and plans without Python."""

import re

import duckdb
import pytest
from conftest import frame, prose
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from formpulse.llm import licenses, urls
from formpulse.llm.licenses import TEMPLATES, licences, op3_licences
from formpulse.llm.urls import host_and_path, judge, op8_urls, rule_of

MIT = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 100)


def same(spark, folder, query, sql, tables):
    duck = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    df = query(spark, str(folder))
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    return df.collect()


def test_licences(spark, tmp_path, edge_rows):
    texts = [t for _, t, _, _ in edge_rows] + [
        "Text.\nReleased under the MIT License.", "licensed under cc by-nc 4.0", "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0.",
        MIT, "Preface\n\n" + MIT.replace(", ", ",\n"), MIT + " and " + prose(1, 300).replace("\n", " "), "Released under the MIT", "the the the the the",
        "This work is licensed under the GNU General Public Licence, version 3.", "\n\n\n", "MIT"]
    rows = same(spark, tmp_path, op3_licences, licenses.ORACLE, {"documents": frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])})
    n = len(edge_rows)
    names = {r.doc_id - n: r.licence for r in rows if r.doc_id >= n}
    assert [names[i] for i in range(5)] == ["MIT", "CC-BY-NC-4.0", "CC-BY-4.0", "MIT", "MIT"]
    # A notice within a longer line is found too.
    assert names[5] == "MIT"
    assert licences(frame(spark, []).limit(0)).collect() == []


def test_licences_wherever_they_stand(spark):
    """Every template alone, line by line, in paragraphs of a longer text and inside a longer line."""
    rows, wanted = [], []
    for name, text in TEMPLATES:
        words = text.split()
        lines = "\n".join(" ".join(words[i: i + 9]) for i in range(0, len(words), 9))
        halves = " ".join(words[: len(words) // 2]) + "\n\n" + " ".join(words[len(words) // 2:])
        for shown in (" ".join(words), lines, halves, f"{prose(1, 300)}\n\n{halves}\n\n{prose(2, 300)}",
                      f"This file, part of foo, is {' '.join(words)} See the folder of the project for details.",
                      f"{prose(3, 40)} {' '.join(words)} {prose(4, 40)} {' '.join(words)} {prose(5, 40)}"):
            rows.append((len(rows), shown, "en", "a"))
            wanted.append(name)
    got = {r.doc_id: r.matches for r in licences(frame(spark, rows)).collect()}
    for k, name in enumerate(wanted):
        own = [m for m in got[k] if m.name == name]
        assert own and max(m.dice for m in own) > 0.9, (name, rows[k][1][:80])
        assert all(m.stop > m.start >= 0 and m.shared > 0 for m in own)


def test_licences_that_are_alike_come_apart(spark, tmp_path):
    longest = {name: max((t for n, t in TEMPLATES if n == name), key=len) for name, _ in TEMPLATES}
    alike = ("BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "MIT", "ISC", "Zlib")
    shown = {name: f"{prose(k, 80)}\n\nCopyright (c) 2020 Someone\n\n{longest[name]}\n" for k, name in enumerate(alike)}
    # A notice with words changed here and there, and one of which too much is missing.
    edits = longest["MIT"].split()
    edits[10:100:15] = ["changed"] * len(edits[10:100:15])
    shown["edited"], shown["half"] = " ".join(edits), " ".join(edits[: len(edits) // 4])
    docs = frame(spark, [(k, text, "en", "a") for k, text in enumerate(shown.values())])
    rows = same(spark, tmp_path, op3_licences, licenses.ORACLE, {"documents": docs})
    found = dict(zip(shown, (r.licence for r in sorted(rows, key=lambda r: r.doc_id)), strict=True))
    assert found == {**{name: name for name in alike}, "edited": "MIT", "half": None}


def test_licence_templates_are_an_argument(spark):
    own = [("House", "Only members of this house may read, copy or burn these pages at any time.")]
    texts = ["x " + own[0][1] + " y", "Released under the MIT License."]
    got = {r.doc_id: [(m.name, m.start, m.stop) for m in r.matches]
           for r in licences(frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]), templates=own).collect()}
    assert got == {0: [("House", 1, 16)], 1: []}



PAGES = [
    (1, "http://Www.Example.ORG/es/5?x"), (2, "https://example.org/en/17"), (3, "https://m.example.org/en/2"), (4, "http://x.com/fr/9"), (5, "http://x.com/de/"),
    (6, "http://x.com/en/a/b/c/d/e/f"), (7, None), (8, "no scheme"), (9, "://"), (10, "http://x.com"), (11, "http://x.com?q=/fr/"), (12, "http://notcom/fr/"),
    (13, "http://a://b/fr/c"), (14, "http://x.org#/es/"), (15, "http://x.net//de/3.html#a"), (16, "ftp://ÄB.com/fr/\n1"), (17, "http://org/x"), (18, "http://com/de/1"),
    (None, "http://x.net/y"), (1, "http://x.net/again/1"), (1, "http://x.net/again/1"),
    *((100 + i, f"http://h.net/{'bad' if i % 2 else 'good'}/{i}.html") for i in range(60)), *((200 + i, f"http://h.net/rare{'x' * i}/y") for i in range(9)),
]


def test_urls(spark, tmp_path):
    pages = spark.createDataFrame([(*p, None, "v") for p in PAGES], "page_id bigint, url string, html string, verdict string")
    labels = [(i, int(i % 2 == 0), 0) for i in range(60)] + [(3, None, None), (None, 0, 1), (9, 1, 1), (9, 1, 0), (17, 0, None)]
    rows = same(spark, tmp_path, op8_urls, urls.ORACLE, {"pages": pages, "labels": spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")})
    by = {r.page_id: r for r in rows}
    assert [(by[i].rule, by[i].verdict) for i in (2, 3, 4, 5, 12)] == [
        ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow")]
    assert {by[i].host + by[i].path for i in (7, 8, 9)} == {""} and by[14].rule is None and by[10].path == ""
    assert {by[i].verdict for i in range(101, 160, 2)} == {"block"} and {by[i].verdict for i in range(100, 160, 2)} == {"allow"}
    assert by[101].template == "/bad/*" and by[100].template == "/good/*" and by[200].template == "/*/*" and by[6].template.endswith("/**")


def test_url_branches_below_the_fourth_level(spark):
    """Branches that differ only from the fifth or sixth segment on are judged each; the others stay one."""
    rows = [(i, f"http://h.net/a/b/c/d/{'bad' if i % 2 else 'good'}/{i}.html", i % 2) for i in range(40)]
    rows += [(100 + i, f"http://g.net/a/b/c/d/x{i}y/{'spam' if i % 2 else 'fine'}/p/{i}", i % 2) for i in range(40)]
    rows += [(200 + i, f"http://k.net/a/b/c/d/{'one' if i % 2 else 'two'}/e" + "/f" * (i % 2), i % 3 == 0) for i in range(8)]
    rows += [(300, "http://h.net/a/b/c/d"), (301, "http://h.net/a/b/c/d/rare"), (302, "http://z.net/" + "a/" * 300)]
    pages = spark.createDataFrame([(r[0], r[1]) for r in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows if len(r) > 2], "page_key bigint, bad bigint")
    by = {r.page_id: r for r in judge(pages, labels).collect()}
    assert len(by) == len(rows)
    for first, bad, good in ((0, "bad", "good"), (100, "*/spam", "*/fine")):
        for odd, name, verdict in ((1, bad, "block"), (0, good, "allow")):
            assert {(by[first + i].template, by[first + i].verdict) for i in range(odd, 40, 2)} == {(f"/*/*/*/*/{name}/**", verdict)}
    assert len({by[200 + i].template for i in range(8)}) == 1 and by[200].template.endswith("/**")
    assert by[300].template == "/*/*/*/*" and by[301].template == "/*/*/*/*/**" and by[302].template == "/*/*/*/*/**"


def test_rule_helpers(spark):
    one = spark.range(1).selectExpr("'HTTP://U@Ex.Com:80/A?b' AS url")
    host, path = host_and_path(F.col("url"))
    row = one.select(host, path, rule_of(host, path, (("block", "com:80/A"),))).first()
    assert tuple(row) == ("u@ex.com:80", "/A", ("block", "com:80/A"))
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert judge(empty, spark.createDataFrame([], "page_key bigint, bad bigint")).collect() == []


@pytest.mark.parametrize("name", ["op1_sharding", "op3_licences", "op5_quality", "op8_urls"])
def test_native_queries_have_no_python_and_no_cross_join(spark, name):
    plan = entry_points.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
