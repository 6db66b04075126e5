"""Queries for the mechanisms behind whole runs: counters, mixed layouts, repeated appends."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.aggregates import COMPOSITE_SQL
from checks.columns import RAW_COLUMNS_SQL
from checks.registry import ORACLE, query
from checks.storage import _CLEAN_SQL, export
from formpulse import fixed_values as fv
from formpulse.functions import ratings, text
from formpulse.operators import nps
from formpulse.operators import satisfaction as sat
from formpulse.operators.counters import form_counters
from formpulse.session import work_folder
from formpulse.sources import bindings as b
from formpulse.sources import csv, sinks


def _counters_sql(form: str, table: str, sector: str, questions, means) -> str:
    answers = f"[{', '.join(questions)}]"
    units = ", ".join(
        f"CAST(sum(round({m} * 420)) AS BIGINT) AS u_{m}, count({m}) AS c_{m}" if m in means else
        f"CAST(NULL AS BIGINT) AS u_{m}, CAST(NULL AS BIGINT) AS c_{m}"
        for m in (*(f"m_{x}" for x in fv.BLOCK_SIZES), "m"))
    rated = ", ".join(
        f"CAST(sum(len(list_filter({answers}, lambda v: v = {r}))) AS BIGINT) AS r{r}" for r in range(1, 5))
    buckets = ", ".join(f"{S.count_if(f'ceil(list_avg({answers})) = {r}')} AS b{r}" for r in range(1, 5))
    return (f"SELECT {S.KEYS}, '{form}' AS form, {sector} AS setor, count(*) AS n, {units}, {rated}, {buckets} "
            f"FROM {table} GROUP BY ALL")


@query("form_counters", S.with_("general", "ambulatory", select=" UNION ALL ".join((
    _counters_sql("x", "g", "coalesce(nullif(setor, ''), 'Não informado')", S.Q, [f"m_{x}" for x in fv.BLOCK_SIZES]),
    _counters_sql("y", "a", "'Ambulatório'", fv.AMBULATORY_QUESTIONS, ["m"])))))
def _(spark, d):
    return form_counters(b.general(spark, d), b.ambulatory(spark, d))


_LATER = [c for c in fv.LAYOUTS["general46"] if c not in fv.LAYOUTS["general41"]]


@query("read_mixed_csv", S.with_("raw_general", select=(
    "SELECT nullif(COLUMNS(*), '') FROM (SELECT * REPLACE ("
    + ", ".join(f"CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN NULL ELSE {c} END AS {c}" for c in _LATER)
    + f") FROM (SELECT {RAW_COLUMNS_SQL} FROM rg))")))
def _(spark, d):
    """One folder with exports of the older layout, of 41 columns, and of the newer one, of 46."""
    path, raw = work_folder(spark), b.raw_general(spark, d)
    old = F.col("id").cast("bigint") % 2 == 0
    export(raw.where(old).drop(*_LATER).select(*fv.LAYOUTS["general41"]), path)
    raw.where(~old).write.mode("append").options(**sinks.CSV_OPTIONS).csv(path)
    return csv.read_mixed_csv(spark, path, "general", null_tokens="wide")


@query("likert_ordinal_decomposed", ORACLE["likert_ordinal"])
def _(spark, d):
    """Answers whose accents are combining marks, in capitals for every third form."""
    raw, marks = b.raw_general(spark, d), {"Ó": "O\u0301", "é": "e\u0301", "ã": "a\u0303"}

    def apart(name: str):
        answer = F.col(name)
        for letter, pair in marks.items():
            answer = F.replace(answer, F.lit(letter), F.lit(pair))
        return F.when(F.col("id").cast("bigint") % 3 == 0, F.upper(answer)).otherwise(answer).alias(name)

    written = raw.select("id", *(apart(q) for q in fv.QUESTIONS))
    return written.select(text.cast_id(F.col("id")).alias("id"),
                          *(ratings.likert_ordinal(q).alias(q) for q in fv.QUESTIONS))


@query("satisfaction_by_period_sketch", S.with_("raw_general", extra=(COMPOSITE_SQL,), select="""
SELECT "PERIODO", count(*) AS "QTDE", round(sum(satisfacao), 6) AS "TOTAL_SATISFACAO",
       round(avg(satisfacao), 6) AS "MEDIA", round(quantile_disc(satisfacao, 0.5), 6) AS "MEDIANA"
FROM c GROUP BY 1"""))
def _(spark, d):
    """With more entries than a period has forms the sketch is exact."""
    composite = sat.composite_satisfaction(b.raw_general(spark, d))
    out = sat.satisfaction_by_period(composite, approx_accuracy=1_000_000)
    return out.withColumns({c: F.round(c, 6) for c in ("TOTAL_SATISFACAO", "MEDIA", "MEDIANA")})


@query("write_clean_parquet_runs", _CLEAN_SQL)
def _(spark, d):
    """Two runs, of which the first is repeated: its rows are there once."""
    path, rows = work_folder(spark), b.manifestations(spark, d)
    first = F.col("mes") <= 6
    for run, part in (("r1", rows.where(first)), ("r2", rows.where(~first)), ("r1", rows.where(first))):
        sinks.write_clean_parquet(part, path, run_id=run)
    return sinks.read_clean_parquet(spark, path, fv.CLEAN_COLUMNS)


@query("nps_quarter_total_own_calendar", ORACLE["nps_quarter_total_full"])
def _(spark, d):
    """Without a calendar the counted months work out their own labels."""
    return nps.nps_quarter_total(nps.nps_rows(b.general(spark, d), b.ambulatory(spark, d)))
