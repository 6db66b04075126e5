"""Fused counters, layouts by header, Unicode answers, sketched medians, run ids, the calendar in the plan."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions.ratings import likert_ordinal
from formpulse.operators import nps, ratings, satisfaction
from formpulse.operators.calendar import calendar_of
from formpulse.operators.counters import counted_reports, form_counters
from formpulse.plans.monthly import COUNTED, monthly_tables
from formpulse.sources import bindings as b
from formpulse.sources import load_survey_bundle, read_mixed_csv, sinks, write_clean_parquet, write_raw_snapshot
from formpulse.sources.csv import MALFORMED, header_arities

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def forms(spark, tmp_path_factory):
    """Both forms as clean parquet."""
    out = {}
    for name, df in (("p1", b.general(spark, DATA)), ("p2", b.ambulatory(spark, DATA))):
        path = str(tmp_path_factory.mktemp(name))
        df.write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counters_scan_each_form_once(forms, tmp_path):
    counters = form_counters(forms["p1"], forms["p2"])
    text = plan(counters)
    assert text.count("FileScan") == 2 and "Join" not in text and len(re.findall(r"\bExchange\b", text)) == 2
    counters.write.parquet(str(tmp_path / "c"))
    stored = counters.sparkSession.read.parquet(str(tmp_path / "c"))
    tables = monthly_tables(forms["p1"], forms["p2"], stored)
    for name in COUNTED:
        scans = re.findall(r"FileScan.*?Location: [^\[]*\[([^\]]*)", plan(tables[name]))
        assert scans and all(str(tmp_path) in s for s in scans), name


@pytest.mark.parametrize("complete", [False, True])
def test_reports_of_counters(forms, complete):
    p1, p2 = forms["p1"], forms["p2"]
    direct = {
        "medidas": satisfaction.measure_summary(p1, p2),
        "avaliacoes": ratings.rating_distribution(p1, p2, complete=complete),
        "histograma": ratings.mean_rating_histogram(p1, p2),
        "indicadores": ratings.good_or_excellent_indicator(p1, p2, complete=complete),
        "setores": ratings.sector_form_counts(p1, p2),
    }
    counted = counted_reports(form_counters(p1, p2), complete=complete)
    for name, table in direct.items():
        assert counted[name].dtypes == table.dtypes
        assert sorted(map(repr, counted[name].collect())) == sorted(map(repr, table.collect())), name


def test_counters_of_one_form_alone(forms):
    """Periods that one form lacks, and no forms at all."""
    p1, p2 = forms["p1"], forms["p2"]
    counted = counted_reports(form_counters(p1, p2.limit(0)))
    assert sorted(map(repr, counted["medidas"].collect())) == sorted(
        map(repr, satisfaction.measure_summary(p1, p2.limit(0)).collect()))
    assert all(df.count() == 0 for df in counted_reports(form_counters(p1.limit(0), p2.limit(0))).values())


def export(folder: Path, name: str, header: str, *lines: str):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")


def test_each_file_by_its_header(spark, tmp_path):
    old, new = (list(fv.LAYOUTS[n]) for n in ("ambulatory12", "ambulatory13"))
    record = {c: c for c in new} | {"id": "1", "elogios": '"um, dois\ntrês"', "nps": "9"}
    export(tmp_path, "new.csv", ",".join(['"Nota, de 0 a 10"', *new[1:]]), ",".join(record[c] for c in new))
    export(tmp_path, "old file é.csv", ",".join(old), ",".join(record[c] for c in old), "a,b")
    assert sorted(header_arities(spark, str(tmp_path)).values()) == [12, 13]
    rows = read_mixed_csv(spark, str(tmp_path), "ambulatory", malformed_column=MALFORMED)
    assert rows.columns == [*new, MALFORMED]
    good = sorted(rows.where(F.col(MALFORMED).isNull()).collect(), key=lambda r: r.nps or "")
    assert [r.nps for r in good] == [None, "9"] and {r.elogios for r in good} == {"um, dois\ntrês"}
    assert {r.medico for r in good} == {"medico"}
    assert [r[MALFORMED] for r in rows.where(F.col(MALFORMED).isNotNull()).collect()] == ["a,b"]
    export(tmp_path, "odd.csv", "x,y", "1,2")
    with pytest.raises(ValueError, match="no ambulatory layout has 2 columns"):
        read_mixed_csv(spark, str(tmp_path), "ambulatory")
    rows = read_mixed_csv(spark, str(tmp_path), "ambulatory", malformed_column=MALFORMED)
    assert {r[MALFORMED] for r in rows.where(F.col(MALFORMED).isNotNull()).collect()} == {"a,b", "1,2"}


def test_bundle_of_mixed_folders(spark, tmp_path):
    old, new = fv.LAYOUTS["general41"], fv.LAYOUTS["general46"]
    export(tmp_path / "g", "a.csv", ",".join(old), ",".join("02/01/2019 10:00:00" if c == "data" else "1" for c in old))
    export(tmp_path / "g", "b.csv", ",".join(new), ",".join("02/01/2019 10:00:00" if c == "data" else "2" for c in new))
    ambulatory = fv.LAYOUTS["ambulatory12"]
    export(tmp_path / "a", "c.csv", ",".join(ambulatory), ",".join("02/01/2019 10:00:00" if c == "data" else "3" for c in ambulatory))
    bundle = load_survey_bundle(spark, f"{tmp_path}/g", f"{tmp_path}/a", general_layout=None, ambulatory_layout=None)
    assert sorted((r.id, r.nps) for r in bundle["p1"].collect()) == [(1, None), (2, 2)]
    assert [(r.id, r.nps) for r in bundle["p2"].collect()] == [(3, None)] and bundle["rejects"].count() == 0


def test_answers_with_combining_marks(spark):
    answers = ["Ótimo", "O\u0301timo", "OTIMO", "o\u0301TIMO", "Bom", "bom", "BO\u0308M", "Regular", "ruim", "Pe\u0301ssimo",
               "Na\u0303o se aplica", "", None, "bom ", "otimos"]
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    assert [r.x for r in df.select(likert_ordinal("a").alias("x")).collect()] == [
        4, 4, 4, 4, 3, 3, 3, 2, 1, None, None, None, None, None, None]


@pytest.mark.parametrize("accuracy", [10, 100])
def test_sketched_median_is_within_its_bound(spark, accuracy):
    pick = random.Random(accuracy)
    values = {p: [round(pick.betavariate(2, 1 + p), 4) for _ in range(3000)] for p in (1, 2)}
    df = spark.createDataFrame([(p, v) for p, vs in values.items() for v in [*vs, None]], "PERIODO int, SATISFACAO double").repartition(7)
    exact = {r.PERIODO: r for r in satisfaction.satisfaction_by_period(df).collect()}
    for r in satisfaction.satisfaction_by_period(df, approx_accuracy=accuracy).collect():
        below = sum(v < r.MEDIANA for v in values[r.PERIODO])
        upto = sum(v <= r.MEDIANA for v in values[r.PERIODO])
        slack = 3000 / accuracy
        assert below - slack <= 1500 <= upto + slack
        assert (r.QTDE, r.TOTAL_SATISFACAO, r.MEDIA) == tuple(exact[r.PERIODO][c] for c in ("QTDE", "TOTAL_SATISFACAO", "MEDIA"))
    strict = satisfaction.satisfaction_by_period(df, strict_nulls=True, approx_accuracy=accuracy).collect()
    assert all(r.MEDIANA is None and r.MEDIA is None and r.QTDE == 3001 for r in strict)
    none = spark.createDataFrame([(1, None)], "PERIODO int, SATISFACAO double")
    assert satisfaction.satisfaction_by_period(none, approx_accuracy=9).collect() == satisfaction.satisfaction_by_period(none).collect()


def test_appends_of_a_run_count_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 2024, 1), (2, 2024, 2)], "id int, ano int, mes int")
    for run, part in (("a-1", rows), ("b", rows.where("mes = 1")), ("a-1", rows.where("mes = 2")), ("b", rows.where("mes = 1"))):
        write_clean_parquet(part, path, run_id=run)
    out = sinks.read_clean_parquet(spark, path)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2024, 1), (2, 2024, 2)] and out.columns == ["id", "ano", "mes"]
    for _ in range(2):
        write_raw_snapshot(rows, str(tmp_path / "raw"), ingest_date="2024-05-01", run_id="a")
    assert spark.read.option("header", True).csv(str(tmp_path / "raw")).count() == 2
    with pytest.raises(ValueError, match="not the id of a run"):
        write_clean_parquet(rows, path, run_id="a/b")


def test_calendar_runs_nothing_before_a_report(spark, forms):
    spark.sparkContext.setJobGroup("calendar", "no job may run")
    try:
        calendar = calendar_of(forms["p1"], forms["p2"])
        report = nps.nps_by_period_origin(nps.nps_rows(forms["p1"], forms["p2"]))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("calendar")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    years = {r.ANO for r in calendar.select("ANO").distinct().collect()}
    assert min(years) <= 1994 and calendar.count() == 12 * len(years)
    text = plan(report)
    assert text.count("FileScan") == 2 and "Join" not in text
    with_calendar = nps.nps_by_period_origin(nps.nps_rows(forms["p1"], forms["p2"]), calendar)
    assert sorted(map(repr, report.collect())) == sorted(map(repr, with_calendar.collect()))
    empty = calendar_of(forms["p1"].limit(0))
    assert empty.count() == 12
