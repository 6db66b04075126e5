"""Queries for whole runs, rejects, policies and two-site keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.aggregates import _BALANCE, _summary_sql
from checks.registry import ORACLE, query
from checks.storage import export
from formpulse import fixed_values as fv
from formpulse.operators import calendar as cal
from formpulse.operators import nps, periods
from formpulse.operators import satisfaction as sat
from formpulse.plans import run_monthly
from formpulse.session import work_folder
from formpulse.sources import audit, bundle, csv
from formpulse.sources import bindings as b
from formpulse.streaming import compact_period_stats, read_period_stats, stream_period_stats

# --- Streams, rejects, runs ------------------------------------------------------------------


@query("stream_backlog", """
SELECT CASE WHEN user_id % 13 <> 0 THEN CAST(ts AS DATE) END AS dia,
       'SETOR ' || (user_id % 8) AS setor,
       CASE event_type WHEN 'purchase' THEN 'elogio' WHEN 'signup' THEN 'sugestao'
         WHEN 'error' THEN 'reclamacao' ELSE 'preferiu nao informar' END AS tipo, count(*) AS n
FROM events GROUP BY ALL""")
def _(spark, d):
    """A backlog in random order, one file per batch, a thirteenth of it undated, compacted."""
    root = work_folder(spark)
    rows = b.event_manifestations(spark.read.parquet(f"{d}/events.parquet").withColumn(
        "ts", F.when(F.col("user_id") % 13 != 0, F.col("ts"))))
    rows.repartition(6, F.xxhash64("data", "setor", "tipo")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stream_period_stats(stream, f"{root}/stats", f"{root}/progress").awaitTermination()
    compact_period_stats(spark, f"{root}/stats")
    return read_period_stats(spark, f"{root}/stats")


@query("csv_rejects", S.with_("raw_manifestations", select="""
SELECT CASE WHEN k % 10 = 0 THEN 'short' WHEN k % 10 = 1 THEN 'long' ELSE 'good' END AS kind,
       count(*) AS n FROM rm GROUP BY 1"""))
def _(spark, d):
    """Exports with records that lack two columns or have two more."""
    path = work_folder(spark)
    orders = spark.read.parquet(f"{d}/orders.parquet")
    cells = ["'01/05/2024 10:00:00'", "'UTI'", "'9'", "'outro'", "'texto'", "''", "''", "'ana'"]
    line = F.expr(f"concat_ws(',', {', '.join(cells)}) || CASE WHEN o_orderkey % 10 = 0 THEN '' "
                  "WHEN o_orderkey % 10 = 1 THEN ',0,a@b,x,y' ELSE ',0,a@b' END")
    header = ",".join(fv.LAYOUTS["manifestation10"])
    orders.select(line.alias(header)).write.options(header=True, sep="\x01", quote="\x00").csv(path)
    good, rejects = csv.split_malformed(csv.read_survey_csv(
        spark, path, "manifestation10", malformed_column=csv.MALFORMED))
    columns = F.size(F.split("registro", ","))
    kinds = good.select(F.lit("good").alias("kind")).union(
        rejects.select(F.when(columns < 10, "short").otherwise("long")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@query("run_monthly_periods", ORACLE["measure_summary"])
def _(spark, d):
    """A run of all periods, then one of a single month into the same folder: all are still there."""
    root = work_folder(spark)
    general = export(b.raw_general(spark, d), f"{root}/general")
    ambulatory = export(b.raw_ambulatory(spark, d), f"{root}/ambulatory")
    for period in (None, (1998, "Maio")):
        paths = run_monthly(spark, general, ambulatory, f"{root}/out", period=period, min_year=None)
    out = spark.read.parquet(paths["medidas"])
    return out.withColumn("percentual", F.round("percentual", 6))


@query("run_log", S.with_("raw_general", "raw_ambulatory", select="""
SELECT 'general' AS source, 'success' AS status, count(*) AS n_rows, 0::BIGINT AS n_malformed,
       0::BIGINT AS n_undated, count(*) FILTER (WHERE year(d) < 1997) AS n_before_min_year FROM rg
UNION ALL SELECT 'ambulatory', 'success', count(*), 0, 0, 0 FROM ra"""))
def _(spark, d):
    root = work_folder(spark)
    frames = bundle.load_survey_bundle(
        spark, export(b.raw_general(spark, d), f"{root}/general"),
        export(b.raw_ambulatory(spark, d), f"{root}/ambulatory"), min_year=1997)
    audit.write_audit(frames["log"], f"{root}/log")
    return spark.read.json(f"{root}/log").select(
        "source", "status", "n_rows", "n_malformed", "n_undated", "n_before_min_year")


@query("load_survey_bundle_rows", S.with_("general", "ambulatory", select="""
SELECT 'p1' AS form, id, nps, setor, round(m_x, 6) AS m FROM
  (SELECT id, nps, nullif(setor, '') AS setor, m_x, ano FROM g) WHERE ano >= 1996
UNION ALL SELECT 'p2', id, nps, NULL, round(m, 6) FROM a"""))
def _(spark, d):
    root = work_folder(spark)
    frames = bundle.load_survey_bundle(
        spark, export(b.raw_general(spark, d), f"{root}/general"),
        export(b.raw_ambulatory(spark, d), f"{root}/ambulatory"), min_year=1996)
    p1 = frames["p1"].select(F.lit("p1").alias("form"), "id", "nps",
                             F.nullif("setor", F.lit("")).alias("setor"), F.round("m_x", 6).alias("m"))
    p2 = frames["p2"].select(F.lit("p2"), "id", "nps", F.lit(None).cast("string"), F.round("m", 6))
    return p1.union(p2)


# --- Policies and full calendars -------------------------------------------------------------

for _policy, _score in (("detractor", "0"), ("neutral", "7")):
    _sql = _summary_sql("periodo").replace("FROM m GROUP BY", (
        f"FROM (SELECT * REPLACE (coalesce(nps, {_score}) AS nps) FROM m) GROUP BY"))

    @query(f"nps_summary_null_{_policy}", _sql)
    def _(spark, d, policy=_policy):
        return nps.nps_summary(b.manifestations(spark, d), null_score=policy)


_FULL = S.calendar(1994, 2002)
_SPAN = """SELECT "ID_TRIMESTRE", arg_min("PERIODO_CURTO", "MES_ORDINAL") AS first_period,
       arg_max("PERIODO_CURTO", "MES_ORDINAL") AS last_period FROM cal GROUP BY 1"""


@query("nps_quarter_total_full", S.with_("nps_rows", extra=(_FULL,), select="""
SELECT cal."ID_TRIMESTRE", count(*) AS "TOTAL"
FROM n JOIN cal ON n."ANO" = cal."ANO" AND n."MES" = cal."MES" GROUP BY 1"""))
def _(spark, d):
    general, ambulatory = b.general(spark, d), b.ambulatory(spark, d)
    months = cal.calendar_of(general, ambulatory)
    return nps.nps_quarter_total(nps.nps_rows(general, ambulatory), months)


@query("quarter_span_full", S.with_("nps_rows", extra=(_FULL, f"s AS ({_SPAN})"), select="""
SELECT DISTINCT s.* FROM s JOIN cal USING ("ID_TRIMESTRE")
JOIN n ON n."ANO" = cal."ANO" AND n."MES" = cal."MES" """))
def _(spark, d):
    """The calendar's own edges, for the quarters in which there are answers."""
    general, ambulatory = b.general(spark, d), b.ambulatory(spark, d)
    months = cal.calendar_of(general, ambulatory)
    used = nps.nps_quarter_total(nps.nps_rows(general, ambulatory), months).select("ID_TRIMESTRE")
    return periods.quarter_span(months).join(used, "ID_TRIMESTRE", "left_semi")


# --- Two sites -------------------------------------------------------------------------------

_SITE = "CAST(substr(contato, 3) AS BIGINT) % 2"
_NS = f"""ns AS (
  SELECT {_SITE} AS site, ano_consolidacao AS "ANO", mes_consolidacao AS "MES", 'GERAL' AS "ORIGEM",
         {S.sign("nps")} AS "NPS" FROM g WHERE nps IS NOT NULL
  UNION ALL SELECT {_SITE}, ano_consolidacao, mes_consolidacao, 'AMBULATORIO', {S.sign("nps")}
  FROM a WHERE nps IS NOT NULL),
js AS (SELECT ns.*, cal."ID_TRIMESTRE", cal."PERIODO_CURTO"
  FROM ns LEFT JOIN cal ON ns."ANO" = cal."ANO" AND ns."MES" = cal."MES")"""


def sited(forms):
    return forms.withColumn("site", F.substr("contato", F.lit(3)).cast("bigint") % 2)


def sited_rows(spark, d):
    return nps.nps_rows(sited(b.general(spark, d)), sited(b.ambulatory(spark, d)), ["site"])


@query("nps_by_period_origin_site", S.with_("general", "ambulatory", extra=(_FULL, _NS, f"""t AS (
  SELECT site, "PERIODO_CURTO", count(*) AS "QTDE_FORM",
         {S.count_if('''"ORIGEM" = 'GERAL' ''')} AS "QTDE_GERAL",
         {S.count_if('''"ORIGEM" = 'AMBULATORIO' ''')} AS "QTDE_AMBULATORIO",
         CAST(sum("NPS") AS BIGINT) AS "NPS_SCORE" FROM js GROUP BY ALL)"""),
    select=f'SELECT *, {_BALANCE} AS "PROP" FROM t'))
def _(spark, d):
    months = cal.calendar_dimension(spark, 1994, 2002)
    return nps.nps_by_period_origin(sited_rows(spark, d), months, ["site"])


@query("nps_quarter_total_site", S.with_("general", "ambulatory", extra=(_FULL, _NS), select="""
SELECT site, "ID_TRIMESTRE", count(*) AS "TOTAL" FROM js WHERE "ID_TRIMESTRE" IS NOT NULL
GROUP BY ALL"""))
def _(spark, d):
    months = cal.calendar_dimension(spark, 1994, 2002)
    return nps.nps_quarter_total(sited_rows(spark, d), months, ["site"])


@query("nps_composition_site", S.with_("general", "ambulatory", extra=(_FULL, _NS), select=f"""
SELECT site, "ID_TRIMESTRE", "PERIODO_CURTO" AS "PERIODO", {S.count_if('"NPS" = -1')} AS "DETRATORES",
       {S.count_if('"NPS" = 0')} AS "NEUTRO", {S.count_if('"NPS" = 1')} AS "PROMOTORES",
       count(*) AS "TOTAL" FROM js WHERE "ID_TRIMESTRE" IS NOT NULL GROUP BY ALL"""))
def _(spark, d):
    months = cal.calendar_dimension(spark, 1994, 2002)
    out = nps.nps_composition(sited_rows(spark, d), months, keys=["site"])
    return out.select("site", "ID_TRIMESTRE", "PERIODO", *nps.CLASS_COUNTS, "TOTAL")


@query("reception_frequency_site", S.with_("raw_ambulatory", select=f"""
SELECT {_SITE} AS site, ano_consolidacao AS "ANO",
       CASE WHEN mes_texto IN {tuple(fv.MONTHS)} THEN mes_texto END AS "MES",
       count(*) AS "N_RESPOSTAS", {S.count_if("recepcao IN ('Bom', 'Ótimo')")} AS "BOM_OTIMO"
FROM ra WHERE ano_consolidacao >= 1996 AND {S.fifths("recepcao")} > 0 GROUP BY ALL"""))
def _(spark, d):
    out = sat.reception_frequency(sited(b.raw_ambulatory(spark, d)), 1996, keys=["site"])
    return out.select("site", "ANO", "MES", "N_RESPOSTAS", "BOM_OTIMO")


@query("answer_frequency_site", S.with_("raw_ambulatory", select=f"""
SELECT {_SITE} AS site, recepcao AS resposta, count(*) AS n FROM ra WHERE recepcao IS NOT NULL
GROUP BY ALL"""))
def _(spark, d):
    return sat.answer_frequency(sited(b.raw_ambulatory(spark, d)), "recepcao", ["site"])


@query("score_distribution_site", S.with_("raw_general", select=f"""
SELECT {_SITE} AS site, {S.score("h_2")} AS score, count(*) AS n FROM rg
WHERE ano_consolidacao = 1999 GROUP BY ALL"""))
def _(spark, d):
    return sat.score_distribution_for_year(sited(b.raw_general(spark, d)), 1999, keys=["site"])


@query("month_answer_crosstab_site", S.with_("raw_general", select=(
    f"SELECT {_SITE} AS site, mes_texto AS mes_consolidacao, "
    + ", ".join(S.count_if(f"h_2 = {S.lit(x)}") + f' AS "{x}"' for x in fv.RECEPTION_ANSWERS)
    + f", {S.count_if(f'h_2 NOT IN {fv.RECEPTION_ANSWERS}')} AS outros"
    + " FROM rg WHERE ano_consolidacao = 1999 AND h_2 IS NOT NULL GROUP BY ALL")))
def _(spark, d):
    return sat.month_answer_crosstab(
        sited(b.raw_general(spark, d)), 1999, keys=["site"], others="outros")
