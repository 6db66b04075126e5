"""The stages on planted cases, each judged on its input."""

import re

from conftest import SCHEMA, edited, frame, prose

import corpus_pipeline
from formpulse.llm.packing import PIECES


def planted(spark):
    notice = "This very line of boilerplate stands below many articles"
    item = prose(7000, 45)
    rows = [(i, prose(i, 120) + (f"\n{notice}" if i % 3 == 0 else ""), "en", f"s{i % 2}") for i in range(150)]
    rows += [(200 + i, prose(200, 130), "en", "s0") for i in range(2)] + [(300 + i, edited(prose(300, 200), i, i), "en", "s0") for i in range(2)]
    rows += [(400 + i, " ".join(w + "$$$***" for w in prose(400 + i, 90).split(" ")), "en", "s1") for i in range(9)]
    rows += [(500 + i, prose(500 + i, 60) + " " + item + " " + prose(600 + i, 40), "en", "s1") for i in range(2)]
    rows += [(700 + i, prose(700, 130), "en", "s1") for i in range(4)]
    rows += [(900, None, None, None), (901, "", "en", "s0"), (None, prose(902, 90), None, None), (3, prose(903, 90), "en", "s1")]
    return frame(spark, rows), spark.createDataFrame([(1, item)], "item_id bigint, text string"), notice


def test_stages(spark, tmp_path):
    docs, bench, notice = planted(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    frames = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], str(tmp_path))
        if number < 4:
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        out.write.parquet(str(tmp_path / f"out{number}"))
        frames.append(spark.read.parquet(str(tmp_path / f"out{number}")))
    clean, lines, single, free, packed = ({r.doc_id for r in f.collect()} for f in frames[1:])
    assert clean == {r.doc_id for r in docs.collect()} - {*range(400, 409), 900, 901}
    texts = frames[2].collect()
    assert sum(notice in r.text for r in texts) == 1 and lines == clean - {701, 702, 703}
    assert all(r.n_chars == len(r.text) for r in texts)
    assert single == lines - {201, 301}
    assert free == single - {500, 501} and packed == free
    assert sum(1 for r in frames[4].collect() if r.doc_id == 3) == 2
    assert frames[5].columns == [re.sub(r" .*", "", c.strip()) for c in PIECES.split(",")]
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, ran.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(
        map(repr, frames[5].select("doc_id", "start", "length", "ids_crc32").collect()))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        assert out.collect() == []
