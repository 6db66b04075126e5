"""Queries for readers, sinks, the audit and streaming: each writes and reads whole tables.

Files go to a new folder of the cluster's shared checkpoint directory.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.aggregates import _DISTINCT_COMMENTS, _summary_sql
from checks.columns import RAW_COLUMNS_SQL
from checks.filters import _RANKED, _RATED
from checks.registry import ORACLE, query
from formpulse import fixed_values as fv
from formpulse.operators import attendants as att
from formpulse.operators import comments
from formpulse.operators import manifestations as mf
from formpulse.session import work_folder
from formpulse.sources import audit, bundle, csv, sinks
from formpulse.sources import bindings as b
from formpulse.streaming import (
    compact_ingested,
    compact_reports,
    read_ingested,
    read_period_stats,
    read_report,
    refresh_if_stale,
    stream_ingest,
    stream_period_stats,
    stream_reports,
)


def export(df, path: str) -> str:
    """Write raw forms as the CSV export that a form tool gives: blanks for missing answers."""
    df.write.options(**sinks.CSV_OPTIONS).csv(path)
    return path


def _blank_as_null(columns_sql: str) -> str:
    """In an unquoted CSV export a blank answer and a missing one are the same."""
    return f"SELECT nullif(COLUMNS(*), '') FROM (SELECT {columns_sql} FROM rg)"


@query("read_survey_csv", S.with_("raw_general", select=_blank_as_null(RAW_COLUMNS_SQL)))
def _(spark, d):
    path = export(b.raw_general(spark, d), work_folder(spark))
    return csv.read_survey_csv(spark, path, "general46", null_tokens="wide")


_P1 = ", ".join(f"m_{x}" for x in fv.BLOCK_SIZES)


@query("load_survey_bundle", S.with_("general", "ambulatory", select=f"""
SELECT 'p1' AS frame, count(*) AS n, count(nps) AS scored, CAST(sum(nps) AS BIGINT) AS total
FROM g WHERE ano >= 1996
UNION ALL SELECT 'p1_medias', count(*), count(m_a), CAST(sum(round(m_a * 420)) AS BIGINT)
FROM g WHERE ano >= 1996
UNION ALL SELECT 'p2', count(*), count(nps), CAST(sum(nps) AS BIGINT) FROM a
UNION ALL SELECT 'p2_medias', count(*), count(m), CAST(sum(round(m * 420)) AS BIGINT) FROM a"""))
def _(spark, d):
    root = work_folder(spark)
    frames = bundle.load_survey_bundle(
        spark, export(b.raw_general(spark, d), f"{root}/general"),
        export(b.raw_ambulatory(spark, d), f"{root}/ambulatory"), min_year=1996)
    measured = {"p1": F.col("nps"), "p1_medias": F.col("m_a") * 420,
                "p2": F.col("nps"), "p2_medias": F.col("m") * 420}
    parts = [
        frames[name].select(F.lit(name).alias("frame"), F.rint(value).cast("bigint").alias("v"))
        for name, value in measured.items()
    ]
    both = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return both.groupBy("frame").agg(F.count("*").alias("n"), F.count("v").alias("scored"),
                                     F.sum("v").alias("total"))


@query("write_raw_snapshot", S.with_("raw_manifestations", select="""
SELECT strftime(d, '%d/%m/%Y %H:%M:%S') AS data, setor, CAST(nps AS VARCHAR) AS nps,
       'outro' AS tipo, elogio, sugestao, reclamacao, nome, telefone, email,
       DATE '2024-05-01' AS ingest_date FROM rm"""))
def _(spark, d):
    path = work_folder(spark)
    sinks.write_raw_snapshot(b.raw_manifestations(spark, d), path, ingest_date="2024-05-01")
    return spark.read.options(**sinks.CSV_OPTIONS).schema(
        "data string, setor string, nps string, tipo string, elogio string, sugestao string, "
        "reclamacao string, nome string, telefone string, email string, ingest_date date"
    ).csv(path)


_CLEAN_SQL = S.with_("manifestations", select=f"SELECT {', '.join(fv.CLEAN_COLUMNS)} FROM m")


@query("write_clean_parquet", _CLEAN_SQL)
def _(spark, d):
    path = work_folder(spark)
    sinks.write_clean_parquet(b.manifestations(spark, d), path)
    return sinks.read_clean_parquet(spark, path, fv.CLEAN_COLUMNS)


@query("read_clean_parquet", S.with_("manifestations", select=(
    f"SELECT {', '.join(fv.CLEAN_COLUMNS)} FROM m WHERE ano = 1998 AND mes = 3")))
def _(spark, d):
    path = work_folder(spark)
    sinks.write_clean_parquet(b.manifestations(spark, d), path)
    rows = sinks.read_clean_parquet(spark, path, fv.CLEAN_COLUMNS)
    return rows.where("ano = 1998 AND mes = 3")


_SHARE = S.half_even("CAST(total AS DOUBLE) / sum(total) OVER (PARTITION BY periodo)", 4)


@query("write_period_stats", S.with_("pivot", select=f"""
SELECT *, CAST(sum(total) OVER (PARTITION BY periodo) AS BIGINT) AS n_periodo,
       {_SHARE} AS proporcao FROM p"""))
def _(spark, d):
    path = work_folder(spark)
    stats = mf.sector_share(mf.period_sector_pivot(b.manifestations(spark, d)))
    sinks.write_period_stats(stats, path)
    return spark.read.parquet(path)


_RANK_TEXT = "replace(regexp_replace(CAST(\"RANK\" AS VARCHAR), '\\.0$', ''), '.', ',')"


@query("write_report_csv", S.with_("ambulatory", extra=(_RATED, f"r AS ({_RANKED})"), select=f"""
SELECT ano_consolidacao, mes_consolidacao, atendente, "Bom", "Otimo", "Regular", "Ruim",
       "QTDE_PESQUISADOS", {_RANK_TEXT} AS "RANK" FROM r"""))
def _(spark, d):
    path = work_folder(spark)
    ranking = att.attendant_ranking(b.ambulatory(spark, d))
    keys = ("ano_consolidacao", "mes_consolidacao")
    sinks.write_report_csv(ranking, path, keys=keys)
    # Blank names are quoted in the file, and a missing month has Spark's folder for nulls.
    return spark.read.options(
        **sinks.CSV_OPTIONS, sep=";", emptyValue="", nullValue="\x00").schema(
        'atendente string, Bom bigint, Otimo bigint, Regular bigint, Ruim bigint, '
        'QTDE_PESQUISADOS bigint, RANK string, ano_consolidacao int, mes_consolidacao string'
    ).csv(path)


@query("write_comment_workbooks", S.with_("comments", select=_DISTINCT_COMMENTS))
def _(spark, d):
    path = work_folder(spark)
    rows = comments.extract_comments_distinct(b.raw_comment_general(spark, d),
                                              b.raw_comment_ambulatory(spark, d))
    sinks.write_comment_workbooks(rows, path, keys=("ano_consolidacao", "mes_consolidacao"))
    return spark.read.options(**sinks.CSV_OPTIONS, sep=";", multiLine=True).schema(
        "texto string, ano_consolidacao int, mes_consolidacao string, kind string").csv(path)


@query("ingest_audit", S.with_("raw_manifestations", select="""
SELECT 'orders' AS source, 'success' AS status, count(*) AS n_rows,
       count(*) FILTER (WHERE month(d) = 7) AS n_bad_date,
       count(*) FILTER (WHERE nps = 4) AS n_bad_score, 0::BIGINT AS n_malformed FROM rm"""))
def _(spark, d):
    raw = b.raw_manifestations(spark, d)
    dirty = raw.withColumns({
        "data": F.when(F.col("data").substr(4, 2) == "07", "xx").otherwise(F.col("data")),
        "nps": F.when(F.col("nps") == "4", "quatro").otherwise(F.col("nps")),
    })
    return audit.ingest_audit(dirty, "orders").drop("ts")


@query("stream_ingest", _CLEAN_SQL)
def _(spark, d):
    root = work_folder(spark)
    drop = export(b.raw_manifestations(spark, d), f"{root}/drop")
    stream_ingest(spark, drop, f"{root}/table", f"{root}/progress").awaitTermination()
    return sinks.read_clean_parquet(spark, f"{root}/table", fv.CLEAN_COLUMNS)


@query("refresh_if_stale", _CLEAN_SQL)
def _(spark, d):
    """Two drops and three looks: a fresh table stays as it is, a stale one takes in what waits."""
    root = work_folder(spark)
    raw = b.raw_manifestations(spark, d)
    early = F.col("data").substr(7, 4) < "1998"
    paths = (f"{root}/drop", f"{root}/table", f"{root}/progress")
    looked = []
    for drop, max_age in ((raw.where(early), 3600), (raw.where(~early), 3600), (None, -1)):
        if drop is not None:
            drop.write.mode("append").options(**sinks.CSV_OPTIONS).csv(paths[0])
        looked.append(refresh_if_stale(spark, *paths, max_age=max_age))
    if looked != [True, False, True]:
        raise ValueError(f"a fresh table must not be refreshed, a stale one must: {looked}")
    return read_ingested(spark, paths[1], columns=fv.CLEAN_COLUMNS)


def _in_three_drops(spark, d, root: str):
    """Drops that all touch every period, each taken in before the next; yields after each."""
    raw = b.raw_manifestations(spark, d)
    for part in range(3):
        drop = raw.where(F.pmod(F.hash("data", "nome", "email"), F.lit(3)) == part)
        drop.write.mode("append").options(**sinks.CSV_OPTIONS).csv(f"{root}/drop")
        stream_reports(spark, f"{root}/drop", root).awaitTermination()
        yield part


@query("compact_ingested", _CLEAN_SQL)
def _(spark, d):
    """Batches folded twice, with one after the last fold."""
    root = work_folder(spark)
    for part in _in_three_drops(spark, d, root):
        if part < 2:
            compact_ingested(spark, f"{root}/clean")
    return read_ingested(spark, f"{root}/clean", columns=fv.CLEAN_COLUMNS)


@query("stream_reports", ORACLE["write_period_stats"])
def _(spark, d):
    """Shares kept current over three batches, with a compaction between them."""
    root = work_folder(spark)
    for part in _in_three_drops(spark, d, root):
        if part == 1:
            compact_reports(spark, root)
    return read_report(spark, root, "estatisticas")


@query("stream_reports_nps", _summary_sql("periodo").replace("FROM m GROUP BY", (
    "FROM (SELECT * REPLACE (coalesce(nps, 0) AS nps) FROM m) GROUP BY")))
def _(spark, d):
    root = work_folder(spark)
    for _ in _in_three_drops(spark, d, root):
        pass
    return read_report(spark, root, "nps")


@query("stream_period_stats", """
SELECT CAST(ts AS DATE) AS dia, 'SETOR ' || (user_id % 8) AS setor,
       CASE event_type WHEN 'purchase' THEN 'elogio' WHEN 'signup' THEN 'sugestao'
         WHEN 'error' THEN 'reclamacao' ELSE 'preferiu nao informar' END AS tipo, count(*) AS n
FROM events GROUP BY ALL""")
def _(spark, d):
    root, path = work_folder(spark), f"{d}/events.parquet"
    # A pattern, because a stream takes a single file only through one; it also takes a folder.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    stream_period_stats(b.event_manifestations(stream), f"{root}/stats",
                        f"{root}/progress").awaitTermination()
    return read_period_stats(spark, f"{root}/stats")

