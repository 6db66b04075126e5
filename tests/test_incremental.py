"""One pass per batch, the staleness rule, folds under readers, and reports kept current."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.operators import manifestations as mf
from formpulse.operators.nps import nps_summary
from formpulse.sources import read_survey_csv
from formpulse.sources.normalize import clean_manifestations
from formpulse.streaming import (
    compact_ingested,
    compact_reports,
    fold_batches,
    read_batches,
    read_ingested,
    read_report,
    refresh_if_stale,
    stream_ingest,
    stream_reports,
)
from formpulse.streaming import ingest, reports

HEADER = ",".join(f"Pergunta {i}" for i in range(10))


def drop(root: Path, name: str, *lines: str) -> None:
    folder = root / "drop"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.csv").write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")


def form(day: str, sector: str = "UTI", score: str = "9", text: str = "bom") -> str:
    return f"{day} 10:00:00,{sector},{score},x,{text},,,ana,0,a@b"


def take(spark, root):
    query = stream_ingest(spark, f"{root}/drop", f"{root}/t", f"{root}/progress")
    query.awaitTermination()
    return query


def log(spark, root):
    return [(r.batch_id, r.status, r.n_rows, r.n_bad_date, r.n_bad_score, r.n_malformed) for r in sorted(
        spark.read.json(f"{root}/t-log").collect(), key=lambda r: r.batch_id)]


def test_a_batch_is_parsed_once(spark, tmp_path):
    drop(tmp_path, "a", *(form(f"{d:02d}/05/2024") for d in range(1, 29)), form("xx"), form("01/06/2024", score="nove"))
    query = take(spark, tmp_path)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 30
    assert log(spark, tmp_path) == [(0, "success", 30, 1, 1, 0)]
    assert not (tmp_path / "t-rejects").exists()
    drop(tmp_path, "b", form("02/06/2024"), "short,UTI", form("03/06/2024") + ",more")
    query = take(spark, tmp_path)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 6  # a second scan for the rejects
    assert log(spark, tmp_path)[1] == (1, "success", 3, 1, 0, 2)
    assert {r.primeiro for r in spark.read.json(f"{tmp_path}/t-rejects").collect()} == {"short", "03/06/2024 10:00:00"}
    rows = read_ingested(spark, f"{tmp_path}/t")
    assert rows.count() == 31 and not [c for c in rows.columns if c.startswith("_")]


def test_export_without_records(spark, tmp_path):
    drop(tmp_path, "empty")
    take(spark, tmp_path)
    assert log(spark, tmp_path) == [(0, "error", 0, 0, 0, 0)]


def test_refresh_only_if_stale(spark, tmp_path):
    paths = [f"{tmp_path}/{p}" for p in ("drop", "t", "progress")]
    now = dt.datetime.now(dt.timezone.utc)

    def rows():
        return read_ingested(spark, paths[1]).count()

    drop(tmp_path, "a", form("01/05/2024"))
    assert refresh_if_stale(spark, *paths) and rows() == 1  # no table yet
    drop(tmp_path, "b", form("02/05/2024"))
    assert not refresh_if_stale(spark, *paths) and rows() == 1
    assert not refresh_if_stale(spark, *paths, now=now + dt.timedelta(minutes=59)) and rows() == 1
    assert refresh_if_stale(spark, *paths, now=now + dt.timedelta(hours=2)) and rows() == 2
    age = ingest.table_age(spark, paths[1], now + dt.timedelta(hours=2))
    assert 6000 < age < 7200
    # A look without news makes the table fresh as well.
    assert refresh_if_stale(spark, *paths, max_age=-1) and log(spark, tmp_path)[-1][0] == 1
    assert not refresh_if_stale(spark, *paths, max_age=600)


def test_folds_under_readers(spark, tmp_path):
    path = f"{tmp_path}/t"

    def folders():
        return {int(p.name[9:]) for p in Path(path).glob("batch_id=*")}

    def days():
        return sorted(r.dia.day for r in read_ingested(spark, path).collect())

    for day in range(1, 4):
        drop(tmp_path, str(day), form(f"{day:02d}/05/2024"), form("30/04/2024"))
        take(spark, tmp_path)
    early = read_ingested(spark, path)
    assert compact_ingested(spark, path) and folders() == {0, 1, 2, -3}
    assert days() == [1, 2, 3, 30, 30, 30] and early.count() == 6
    assert not compact_ingested(spark, path)
    assert len(list(Path(f"{path}/batch_id=-3").rglob("*.parquet"))) == 2  # a file a period
    # A fold that did not finish, and a batch that did not: nobody reads them.
    rows = spark.read.parquet(path).drop("batch_id")
    for folder in (-9, 7):
        rows.write.partitionBy("ano", "mes").parquet(f"{path}/batch_id={folder}")
    assert days() == [1, 2, 3, 30, 30, 30]
    drop(tmp_path, "4", form("04/05/2024"))
    take(spark, tmp_path)
    assert days() == [1, 2, 3, 4, 30, 30, 30]
    assert compact_ingested(spark, path) and days() == [1, 2, 3, 4, 30, 30, 30]
    assert folders() == {-9, -3, 3, 7, -4}  # what the fold before had replaced is gone
    drop(tmp_path, "5", form("05/05/2024"))
    take(spark, tmp_path)
    assert compact_ingested(spark, path) and folders() == {-9, -4, 4, 7, -5}
    assert days() == [1, 2, 3, 4, 5, 30, 30, 30]


def test_fold_of_counters(spark, tmp_path):
    path = str(tmp_path / "c")
    for batch in range(3):
        spark.createDataFrame([(1, 2), (2, batch)], "k int, n int").write.partitionBy("k").parquet(f"{path}/batch_id={batch}")
    assert fold_batches(spark, path, 1, keys=["k"], merge=lambda df: df.groupBy("k").agg(F.sum("n").cast("int").alias("n")))
    rows = sorted((r.k, r.n) for r in read_batches(spark, path).collect())
    assert rows == [(1, 2), (1, 4), (2, 1), (2, 2)]
    plan = read_batches(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "batch_id" in plan


def test_reports_stay_current(spark, tmp_path):
    """Every report equals a full recompute after each batch, undated rows and folds included."""
    drops = [
        [form("01/05/2024"), form("02/05/2024", "UTI", "3", ""), form("xx", "UTI", "10")],
        [form("03/05/2024", "", ""), form("04/06/2024", "Enfermaria", "8"), form("01/05/2023")],
        [form("05/06/2024", "UTI", "0"), form("xx", "", "2"), form("31/12/2022")],
    ]
    out = str(tmp_path)
    for number, lines in enumerate(drops):
        drop(tmp_path, str(number), *lines)
        stream_reports(spark, f"{out}/drop", out).awaitTermination()
        clean = clean_manifestations(read_survey_csv(spark, f"{out}/drop", "manifestation10", null_tokens="wide"))
        pivot = mf.period_sector_pivot(clean)
        full = {"estatisticas": mf.sector_share(pivot), "totais": mf.headline_totals(pivot), "por_dia": mf.daily_counts(clean),
                "por_setor": mf.sector_counts(clean), "nps": nps_summary(clean, null_score="detractor")}
        for name, table in full.items():
            current = read_report(spark, out, name)
            assert sorted(current.columns) == sorted(table.columns)
            assert sorted(map(repr, current.select(table.columns).collect())) == sorted(map(repr, table.collect())), name
        if number == 1:
            assert compact_reports(spark, out)


def test_only_touched_periods_are_scanned_and_replaced(spark, tmp_path):
    out = str(tmp_path)
    drop(tmp_path, "a", form("01/05/2024"), form("01/06/2024"))
    stream_reports(spark, f"{out}/drop", out).awaitTermination()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "reports").rglob("*.parquet")}
    drop(tmp_path, "b", form("02/06/2024"))
    stream_reports(spark, f"{out}/drop", out).awaitTermination()
    kept = {p for p in before if p.exists()}
    assert len(before) == 10 and {p.parent.name for p in kept} == {"mes=5"} and len(kept) == 5
    counters = read_batches(spark, f"{out}/counters").where(reports.in_periods([(2024, 6)]))
    plan = counters._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "mes" in plan.split("PartitionFilters")[1][:300]
    assert sum(counters.select(F.col("n")).toPandas()["n"]) == 2


@pytest.mark.parametrize("score", ["drop", "neutral"])
def test_score_policies_from_counters(spark, score):
    rows = clean_manifestations(spark.createDataFrame(
        [(f"0{i % 9 + 1}/05/2024 10:00:00", "UTI", None if i % 3 else str(i % 11), "x", "a", None, None, "n", "1", "e")
         for i in range(40)], ", ".join(f"{c} string" for c in fv.LAYOUTS["manifestation10"])))
    tables = reports.report_tables(reports.count_rows(rows), keys=("periodo",), null_score=score)
    assert tables["nps"].collect() == nps_summary(rows, null_score=score).collect()
