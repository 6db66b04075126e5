import gzip
import hashlib
from pathlib import Path

import pytest

from formpulse.llm import warc
from formpulse.llm.warc import ArchiveError, members, parse, read_archives, record, write_archives

BIG = "<p>" + "x" * 2000
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://a/\r\n3", BIG), (None, None, BIG), (4, None, None), (5, "http://é/", "small"),
        (6, "u", "small"), (7, "u", "é" * 500), (8, "u", "é" * 500), (8, "u", "é" * 500), (9, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 40),
        (10, "u", ""), (11, "u", "y" * 999), (12, "u", "y" * 999)]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").repartition(3)
    archives = write_archives(pages.selectExpr("*", "1 AS digest", "2 AS winner", "3 AS n"), str(tmp_path))
    got = read_archives(archives, str(tmp_path)).collect()
    largest = {}
    for i, _, html in ROWS:
        if i is not None and html is not None and len(html.encode()) >= 1000:
            largest[html] = max(i, largest.get(html, 0))
    want = []
    for i, url, html in ROWS:
        body = (html or "").encode()
        to = largest.get(html) if i is not None and largest.get(html, i) != i else None
        url = url and url.replace("\r\n", "%0D%0A")
        want.append((i, url, "response" if to is None else "revisit", to, hashlib.sha1(body).hexdigest(), len(body), None if to else body))
    assert sorted(map(repr, (tuple(r[:6]) + (r.payload and bytes(r.payload) if r.payload else r.payload,) for r in got))) == sorted(
        repr(w[:6] + (w[6],)).replace("b''", "b''") for w in want)
    assert sum(r.records for r in archives.collect()) == len(ROWS)


def test_every_record_is_a_gzip_member(spark, tmp_path):
    archives = write_archives(spark.createDataFrame(ROWS, "page_id bigint, url string, html string").coalesce(1), str(tmp_path))
    for row in archives.collect():
        raw = Path(row.path).read_bytes()
        found = list(members(iter([raw[i: i + 7] for i in range(0, len(raw), 7)])))  # members across blocks
        assert len(found) == row.records and b"".join(found) == gzip.decompress(raw)


def test_damage_is_seen():
    one = record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    plain = gzip.decompress(one)
    with pytest.raises(ArchiveError):
        list(members(iter([one[:-4]])))
    with pytest.raises(ArchiveError):
        parse(plain.replace(b"payload\r\n", b"paYload\r\n"))
    with pytest.raises(ArchiveError):
        parse(plain.replace(b"Content-Length: 7", b"Content-Length: 6"))
    with pytest.raises(ArchiveError):
        parse(b"HTTP/1.1 200 OK\r\n\r\n")


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert read_archives(write_archives(empty, str(tmp_path)), str(tmp_path)).collect() == []
    empty.write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op9_warc(spark, str(tmp_path)).collect() == []
