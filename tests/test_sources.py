"""Readers, sinks, the audit and streams on small files. All data is invented."""

import datetime as dt
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.plans import dashboard_tables, monthly_tables, nps_tables, refresh_dashboard
from formpulse.plans import run_monthly
from formpulse.operators.calendar import calendar_dimension
from formpulse.session import work_folder
from formpulse.sources import (
    ingest_audit,
    read_survey_csv,
    rename_positional,
    sinks,
    write_audit,
    write_clean_parquet,
    write_report_csv,
)
from formpulse.sources.csv import layout_by_arity
from formpulse.streaming import (
    compact_period_stats,
    read_period_stats,
    stream_ingest,
    stream_period_stats,
)

HEADER = ",".join(f"Pergunta {i}" for i in range(10))


def write_lines(folder: Path, *lines: str, name: str = "form.csv") -> str:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")
    return str(folder)


def test_csv_quotes_breaks_and_nulls(spark, tmp_path):
    path = write_lines(
        tmp_path, '01/05/2024 10:00:00,UTI,9,x,"linha 1, ""dita""\nlinha 2",,NA,ana,0,a@b')
    (row,) = read_survey_csv(spark, path, "manifestation10", null_tokens="wide").collect()
    assert row["elogio"] == 'linha 1, "dita"\nlinha 2'
    assert row["sugestao"] is None and row["reclamacao"] is None
    (blank,) = read_survey_csv(spark, path, "manifestation10", null_tokens="blank").collect()
    assert blank["sugestao"] is None and blank["reclamacao"] == "NA"
    (only,) = read_survey_csv(spark, path, "manifestation10", null_tokens="na_only").collect()
    assert only["sugestao"] == "" and only["reclamacao"] is None


def test_malformed_rows_are_kept_and_counted(spark, tmp_path):
    path = write_lines(tmp_path, "01/05/2024 10:00:00,UTI,9,x,a,,,ana,0,a@b", "xx,UTI,nove,x",
                       "yy,UTI,dez,x,a,,,ana,0,a@b")
    raw = read_survey_csv(spark, path, "manifestation10", malformed_column="_malformed")
    audit = ingest_audit(raw, path, malformed_column="_malformed")
    row = audit.first()
    assert (row["status"], row["n_rows"], row["n_bad_date"], row["n_bad_score"],
            row["n_malformed"]) == ("success", 3, 2, 2, 1)
    write_audit(audit, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_survey_csv(spark, path, "manifestation10", mode="FAILFAST").collect()


def test_positional_names(spark):
    df = spark.range(1).select(*(F.lit(str(i)) for i in range(12)))
    assert rename_positional(df, "ambulatory12").columns == list(fv.LAYOUTS["ambulatory12"])
    with pytest.raises(ValueError, match="13 columns"):
        rename_positional(df, "ambulatory13")
    assert layout_by_arity("general", 41) == "general41"
    with pytest.raises(ValueError, match="no general layout"):
        layout_by_arity("general", 40)


def test_report_csv_format(spark, tmp_path):
    df = spark.createDataFrame(
        [("ATT_1", 20, 11.5, 2019, "Maio"), ("a;b \"c\"\nd ", 3, 4.0, 2019, "Junho")],
        "atendente string, n int, RANK double, ano int, mes string")
    out = tmp_path / "report"
    write_report_csv(df, str(out))
    may = next((out / "ano=2019" / "mes=Maio").glob("*.csv")).read_text(encoding="utf-8")
    assert may == "atendente;n;RANK\nATT_1;20;11,5\n"
    june = next((out / "ano=2019" / "mes=Junho").glob("*.csv")).read_text(encoding="utf-8")
    assert june == 'atendente;n;RANK\n"a;b ""c""\nd ";3;4\n'
    assert {p.name for p in (out / "ano=2019").iterdir()} == {"mes=Maio", "mes=Junho"}


def test_clean_parquet_prunes_by_period(spark, tmp_path):
    df = spark.range(100).select("id", F.lit(2019).alias("ano"), (F.col("id") % 4).alias("mes"))
    write_clean_parquet(df, str(tmp_path / "t"))
    chosen = spark.read.parquet(str(tmp_path / "t")).where("ano = 2019 AND mes = 3")
    assert chosen.count() == 25
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ano" in plan


def test_work_folder_is_in_the_shared_directory(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert work_folder(spark).startswith(shared)


def events(spark, *days):
    return spark.createDataFrame(
        [(dt.datetime(2024, 1, 1) + dt.timedelta(days=d), "elogio", "UTI") for d in days],
        "data timestamp_ntz, tipo string, setor string")


def stats_run(spark, root):
    stream = (spark.readStream.schema("data timestamp_ntz, tipo string, setor string")
              .option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
    stream_period_stats(stream, f"{root}/stats", f"{root}/progress").awaitTermination()


def test_stream_statistics_count_every_row_whatever_the_batches(spark, tmp_path):
    root = str(tmp_path)
    for days in ((5, 5, 20), (400, 1, 5), (40, 20, 1)):
        events(spark, *days).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stats_run(spark, root)
        compact_period_stats(spark, f"{root}/stats")
    spark.createDataFrame([(None, "elogio", "UTI")], "data timestamp_ntz, tipo string, setor string").write.mode(
        "append").parquet(f"{root}/in")
    stats_run(spark, root)
    want = {1: 2, 5: 3, 20: 2, 40: 1, 400: 1, None: 1}
    for _ in range(2):
        got = {r["dia"] and r["dia"].toordinal() - dt.date(2024, 1, 1).toordinal(): r["n"]
               for r in read_period_stats(spark, f"{root}/stats").collect()}
        assert got == want
        compact_period_stats(spark, f"{root}/stats")


def test_malformed_records_of_a_stream_are_kept_apart(spark, tmp_path):
    line = "01/05/2024 10:00:00,UTI,9,x,a,,,ana,0,a@b"
    write_lines(tmp_path / "drop", line, "xx,UTI", line + ",1,2")
    refresh_dashboard(spark, str(tmp_path / "drop"), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out" / "clean"))
    rejects = spark.read.json(str(tmp_path / "out" / "clean-rejects"))
    assert rows.count() == 1 and {r["registro"] for r in rejects.collect()} == {"xx,UTI", line + ",1,2"}
    log = spark.read.json(str(tmp_path / "out" / "clean-log")).collect()
    assert [(r["n_rows"], r["n_malformed"]) for r in log] == [(3, 2)]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_survey_csv(spark, str(tmp_path / "drop"), "manifestation10").collect()


def test_first_run_without_exports_gives_empty_tables(spark, tmp_path):
    (tmp_path / "drop").mkdir()
    tables = refresh_dashboard(spark, str(tmp_path / "drop"), str(tmp_path / "out"))
    assert all(t.count() == 0 for t in tables.values())


def test_null_score_is_one_policy(spark, tmp_path):
    write_lines(tmp_path / "drop", "01/05/2024 10:00:00,UTI,,x,a,,,ana,0,a@b")
    for policy, column in (("detractor", "detratores"), ("neutral", "neutros")):
        tables = refresh_dashboard(spark, str(tmp_path / "drop"), str(tmp_path / policy), null_score=policy)
        assert tables["nps"].first()[column] == 1


def test_a_run_of_one_period_leaves_the_others(spark, tmp_path):
    general = raw_forms(spark, "general46", a_1="Bom", setor="UTI", elogios="bem")
    amb = raw_forms(spark, "ambulatory13", recepcao="Ótimo", medico="Bom", atendente="ATT_1")
    for name, df in (("g", general), ("a", amb)):
        df.write.options(**sinks.CSV_OPTIONS).csv(str(tmp_path / name))
    args = spark, str(tmp_path / "g"), str(tmp_path / "a"), str(tmp_path / "out")
    run_monthly(*args)
    june = sorted(p for p in (tmp_path / "out").rglob("*") if "mes_consolidacao=Junho" in str(p) and p.is_file())
    paths = run_monthly(*args, period=(2019, "Maio"))
    assert june and all(p.exists() for p in june)
    assert spark.read.parquet(paths["medidas"]).count() == 20
    assert spark.read.json(paths["log"]).count() == 4
    run_monthly(*args, period=(2026, "Maio"))
    assert spark.read.parquet(paths["medidas"]).count() == 20


def test_ingest_takes_each_file_once(spark, tmp_path):
    drop = tmp_path / "drop"
    line = "01/05/2024 10:00:00,UTI,9,x,a,,,ana,0,a@b"
    for name in ("a.csv", "b.csv"):
        write_lines(drop, line, name=name)
        for _ in range(2):
            stream_ingest(spark, str(drop), str(tmp_path / "table"),
                          str(tmp_path / "progress")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    tables = refresh_dashboard(spark, str(drop), str(tmp_path / uuid.uuid4().hex), "2024/05")
    assert tables["totais"].first()["elogio"] == 2
    assert tables["manifestacoes"].count() == 2
    assert dashboard_tables(spark.read.parquet(str(tmp_path / "table")))["nps"].count() == 1


def raw_forms(spark, layout, **values):
    base = {c: None for c in fv.LAYOUTS[layout]} | {
        "data": "02/05/2019 10:00:00", "mes_consolidacao": "Maio", "ano_consolidacao": "2019",
        "id": "1", "nps": "9"} | values
    rows = [tuple(base.values()), tuple((base | {"mes_consolidacao": "Junho"}).values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in base))


def test_monthly_run_from_files(spark, tmp_path):
    general = raw_forms(spark, "general46", a_1="Bom", setor="UTI", elogios="bem; \"muito\"\nbem")
    amb = raw_forms(spark, "ambulatory13", recepcao="Ótimo", medico="Bom", atendente="ATT_1")
    for name, df in (("g", general), ("a", amb)):
        df.write.options(**sinks.CSV_OPTIONS).csv(str(tmp_path / name))
    paths = run_monthly(spark, str(tmp_path / "g"), str(tmp_path / "a"), str(tmp_path / "out"),
                        period=(2019, "Maio"))
    measures = spark.read.parquet(paths["medidas"])
    assert measures.count() == 10
    assert measures.where("medida = 'Ambulatório'").first()["percentual"] == 87.5
    ranking = spark.read.options(**sinks.CSV_OPTIONS, sep=";").csv(paths["atendentes"])
    assert ranking.count() == 1
    texts = spark.read.options(**sinks.CSV_OPTIONS, sep=";", multiLine=True).csv(
        paths["comentarios"])
    assert texts.first()["texto"] == "bem; \"muito\"\nbem"


def test_nps_tables(spark):
    from formpulse.sources import normalize_ambulatory, normalize_general

    general = normalize_general(raw_forms(spark, "general46"))
    amb = normalize_ambulatory(raw_forms(spark, "ambulatory13", nps="3"))
    tables = nps_tables(general, amb, calendar_dimension(spark, 2018, 2020), "2019.Q2")
    assert tables["df"].count() == 4
    assert {r["NPS"] for r in tables["composicao"].collect()} == {0.0}
    assert tables["total_por_trimestre"].first()["TOTAL"] == 4
    assert len(monthly_tables(general, amb)) == 10
