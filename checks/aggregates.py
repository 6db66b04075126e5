"""Queries for the aggregate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.columns import COMPOSITE_SQL
from checks.filters import CAL, calendar
from checks.registry import query
from formpulse import fixed_values as fv
from formpulse.operators import comments, nps, ratings, reshape
from formpulse.operators import manifestations as mf
from formpulse.operators import satisfaction as sat
from formpulse.sources import bindings as b


def scored_rows(spark, d):
    return nps.nps_rows(b.general(spark, d), b.ambulatory(spark, d))


@query("form_row_counts", S.with_("raw_general", "raw_ambulatory", select="""
SELECT 'general' AS form, count(*) AS n FROM rg UNION ALL SELECT 'ambulatory', count(*) FROM ra"""))
def _(spark, d):
    forms = b.general(spark, d).select(F.lit("general").alias("form")).union(
        b.ambulatory(spark, d).select(F.lit("ambulatory")))
    return forms.groupBy("form").agg(F.count("*").alias("n"))


# --- Manifestation statistics --------------------------------------------------------------------


@query("period_type_sector_counts", S.with_("manifestations", select=(
    "SELECT periodo, tipo, setor, count(data) AS n FROM m GROUP BY ALL")))
def _(spark, d):
    return mf.period_type_sector_counts(b.manifestations(spark, d))


@query("period_sector_pivot", S.with_("pivot", select="SELECT * FROM p"))
def _(spark, d):
    return mf.period_sector_pivot(b.manifestations(spark, d))


@query("period_totals", S.with_("pivot", select=(
    "SELECT periodo, CAST(sum(total) AS BIGINT) AS n_periodo FROM p GROUP BY periodo")))
def _(spark, d):
    return mf.period_totals(mf.period_sector_pivot(b.manifestations(spark, d)))


_SHARE = S.half_even("CAST(total AS DOUBLE) / sum(total) OVER (PARTITION BY periodo)", 4)


@query("sector_share", S.with_("pivot", select=f"""
SELECT *, CAST(sum(total) OVER (PARTITION BY periodo) AS BIGINT) AS n_periodo,
       {_SHARE} AS proporcao FROM p"""))
def _(spark, d):
    return mf.sector_share(mf.period_sector_pivot(b.manifestations(spark, d)))


@query("headline_totals", S.with_("pivot", select="SELECT periodo, " + ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("total", *mf.TYPE_COLUMNS.values()))
    + " FROM p GROUP BY periodo"))
def _(spark, d):
    return mf.headline_totals(mf.period_sector_pivot(b.manifestations(spark, d)))


@query("sector_headline", S.with_("pivot", select="SELECT periodo, setor, total FROM p"))
def _(spark, d):
    return mf.sector_headline(mf.period_sector_pivot(b.manifestations(spark, d)))


_EVENTS = """SELECT strftime(ts, '%Y/%m') AS periodo, CAST(ts AS DATE) AS dia, count(*) AS n
FROM events GROUP BY ALL"""


@query("daily_counts", _EVENTS)
def _(spark, d):
    rows = b.event_manifestations(spark.read.parquet(f"{d}/events.parquet"))
    dated = rows.withColumns({
        "dia": F.col("data").cast("date"), "periodo": F.date_format("data", "yyyy/MM")})
    return mf.daily_counts(dated)


@query("sector_counts", S.with_("manifestations", select=(
    "SELECT periodo, setor, count(*) AS n FROM m GROUP BY ALL")))
def _(spark, d):
    return mf.sector_counts(b.manifestations(spark, d))


# --- NPS ---------------------------------------------------------------------------------------


def _summary_sql(keys: str) -> str:
    share = {n: f"(CAST({n} AS DOUBLE) / nullif(total, 0))" for n in ("detratores", "neutros", "promotores")}
    score = S.half_even(f"({share['promotores']} - {share['detratores']}) * 100", 2)
    return S.with_("manifestations", extra=(f"""t AS (
  SELECT {keys}, {S.count_if("nps <= 6")} AS detratores, {S.count_if("nps BETWEEN 7 AND 8")}
    AS neutros, {S.count_if("nps >= 9")} AS promotores, count(nps) AS total
  FROM m GROUP BY {keys})""",), select=f"""
SELECT {keys}, detratores, neutros, promotores, total,
       {", ".join(f"{S.percent(f'{x} * 100', 2, True)} AS p_{n}" for n, x in share.items())},
       {score} AS score, {S.zone_v2(score)} AS zona FROM t""")


@query("nps_summary", _summary_sql("periodo"))
def _(spark, d):
    return nps.nps_summary(b.manifestations(spark, d))


@query("nps_summary_by_sector", _summary_sql("periodo, setor"))
def _(spark, d):
    return nps.nps_summary(b.manifestations(spark, d), ["periodo", "setor"])


_BALANCE = S.percent('CAST("NPS_SCORE" AS DOUBLE) / "QTDE_FORM" * 100', 1)


@query("nps_by_month", S.with_("ambulatory", extra=(f"""t AS (
  SELECT ano_consolidacao, mes_consolidacao, count(*) AS "QTDE_FORM",
         CAST(sum({S.sign("nps")}) AS BIGINT) AS "NPS_SCORE"
  FROM a WHERE nps IS NOT NULL GROUP BY ALL)""",), select=f'SELECT *, {_BALANCE} AS "PROP" FROM t'))
def _(spark, d):
    return nps.nps_by_month(b.ambulatory(spark, d))


_JOINED = """j AS (
  SELECT n.*, cal."ID_TRIMESTRE", cal."PERIODO_CURTO"
  FROM n LEFT JOIN cal ON n."ANO" = cal."ANO" AND n."MES" = cal."MES")"""


@query("nps_by_period_origin", S.with_("nps_rows", extra=(CAL, _JOINED, f"""t AS (
  SELECT "PERIODO_CURTO", count(*) AS "QTDE_FORM",
         {S.count_if('''"ORIGEM" = 'GERAL' ''')} AS "QTDE_GERAL",
         {S.count_if('''"ORIGEM" = 'AMBULATORIO' ''')} AS "QTDE_AMBULATORIO",
         CAST(sum("NPS") AS BIGINT) AS "NPS_SCORE" FROM j GROUP BY ALL)"""),
    select=f'SELECT *, {_BALANCE} AS "PROP" FROM t'))
def _(spark, d):
    return nps.nps_by_period_origin(scored_rows(spark, d), calendar(spark))


def _composition_sql(where: str) -> str:
    classes = dict(zip(nps.CLASS_COUNTS, fv.NPS_CLASSES_V1, strict=True))
    counts = ", ".join(S.count_if(f'"CLASSE" = {S.lit(c)}') + f' AS "{n}"'
                       for n, c in classes.items())
    percents = ", ".join(f"""{S.half_even(f'CAST("{n}" * 100 AS DOUBLE) / "TOTAL"')} AS "P_{n}" """
                         for n in classes)
    return S.with_("nps_rows", extra=(CAL, _JOINED, f"""t AS (
  SELECT "ID_TRIMESTRE", "PERIODO_CURTO" AS "PERIODO", {counts}, count(*) AS "TOTAL"
  FROM j WHERE {where} GROUP BY ALL), p AS (SELECT *, {percents} FROM t)"""), select=f"""
SELECT *, "P_PROMOTORES" - "P_DETRATORES" AS "NPS",
       {S.zone_v1('("P_PROMOTORES" - "P_DETRATORES")')} AS "ZONA" FROM p""")


@query("nps_composition", _composition_sql('"ID_TRIMESTRE" IS NOT NULL'))
def _(spark, d):
    return nps.nps_composition(scored_rows(spark, d), calendar(spark))


@query("nps_composition_quarter", _composition_sql("\"ID_TRIMESTRE\" = '1999.Q3'"))
def _(spark, d):
    return nps.nps_composition(scored_rows(spark, d), calendar(spark), "1999.Q3")


@query("nps_quarter_total", S.with_("nps_rows", extra=(CAL, _JOINED), select="""
SELECT "ID_TRIMESTRE", count(*) AS "TOTAL" FROM j WHERE "ID_TRIMESTRE" IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    return nps.nps_quarter_total(scored_rows(spark, d), calendar(spark))


_COMPARED = f"""r AS (
  SELECT ano_consolidacao || '/' || mes_consolidacao AS "PERIODO",
         mes_ordinal AS "MES_ORDINAL", {S.class_v1("nps")} AS classe
  FROM (SELECT ano_consolidacao, mes_consolidacao, mes_ordinal, nps FROM g
        UNION ALL SELECT ano_consolidacao, mes_consolidacao, mes_ordinal, nps FROM a)
  WHERE nps IS NOT NULL AND ano_consolidacao = 1998
    AND mes_consolidacao IN ('Outubro', 'Novembro', 'Dezembro'))"""


def _class_counts(names) -> str:
    return ", ".join(S.count_if(f"classe = {S.lit(c)}") + f' AS "{n}"'
                     for n, c in zip(names, fv.NPS_CLASSES_V1, strict=True))


@query("nps_compare_forms", S.with_("general", "ambulatory", extra=(_COMPARED,), select=f"""
SELECT "PERIODO", "MES_ORDINAL", {_class_counts(nps.CLASS_COUNTS)} FROM r GROUP BY ALL"""))
def _(spark, d):
    return nps.nps_compare_forms(b.general(spark, d), b.ambulatory(spark, d), 1998)


@query("nps_crosstab", S.with_("general", "ambulatory", extra=(_COMPARED,), select=f"""
SELECT "PERIODO", {_class_counts(fv.NPS_CLASSES_V1)} FROM r GROUP BY ALL"""))
def _(spark, d):
    return nps.nps_crosstab(nps.compared_rows(b.general(spark, d), b.ambulatory(spark, d), 1998))


# --- Satisfaction ------------------------------------------------------------------------------

_BLOCKS = [f"m_{x}" for x in fv.BLOCK_SIZES]
_KEYED = "k.ano_consolidacao IS NOT DISTINCT FROM {t}.ano_consolidacao AND " \
         "k.mes_consolidacao IS NOT DISTINCT FROM {t}.mes_consolidacao"


def _mean(c: str) -> str:
    """Mean of block means (multiples of 1/420) in whole numbers: a running sum of doubles is off
    in the last digits, which shows where the exact value lies on a rounding edge."""
    return f"(CAST(sum(CAST(round({c} * 420) AS BIGINT)) AS DOUBLE) / (count({c}) * 420))"


@query("measure_summary", S.with_("general", "ambulatory", extra=(f"""
gm AS (SELECT {S.KEYS}, {", ".join(f"{_mean(c)} * 100 / 4 AS {c}" for c in _BLOCKS)}
  FROM g GROUP BY ALL)""",
    f"am AS (SELECT {S.KEYS}, {_mean('m')} * 100 / 4 AS m FROM a GROUP BY ALL)",
    f"k AS (SELECT {S.KEYS} FROM gm UNION SELECT {S.KEYS} FROM am)",
    f"""w AS (SELECT k.*, {", ".join(f"gm.{c}" for c in _BLOCKS)}, am.m
  FROM k LEFT JOIN gm ON {_KEYED.format(t="gm")} LEFT JOIN am ON {_KEYED.format(t="am")})""",
    f"v AS (SELECT *, list_avg([{', '.join(_BLOCKS)}, m]) AS geral FROM w)"),
    select=" UNION ALL ".join(
        f"SELECT {S.KEYS}, CAST({i} AS INTEGER) AS medida_ordinal, {S.lit(label)} AS medida, "
        f"{S.r6(c)} AS percentual, CAST(80 AS DOUBLE) AS meta FROM v"
        for i, (c, label) in enumerate(
            zip((*_BLOCKS, "m", "geral"), fv.MEASURE_LABELS, strict=True), start=1))))
def _(spark, d):
    out = sat.measure_summary(b.general(spark, d), b.ambulatory(spark, d))
    return out.withColumn("percentual", F.round("percentual", 6))


_STATS = """count(*) AS "QTDE", round(sum(satisfacao), 6) AS "TOTAL_SATISFACAO",
       round(avg(satisfacao), 6) AS "MEDIA", round(median(satisfacao), 6) AS "MEDIANA" """


def _rounded(stats):
    names = ("TOTAL_SATISFACAO", "MEDIA", "MEDIANA")
    return stats.withColumns({c: F.round(c, 6) for c in names})


@query("satisfaction_by_period", S.with_("raw_general", extra=(COMPOSITE_SQL,), select=(
    f'SELECT "PERIODO", {_STATS} FROM c GROUP BY 1')))
def _(spark, d):
    return _rounded(sat.satisfaction_by_period(sat.composite_satisfaction(b.raw_general(spark, d))))


@query("satisfaction_by_period_strict", S.with_("raw_general", extra=(COMPOSITE_SQL,), select="""
SELECT "PERIODO", count(*) AS "QTDE",
       CASE WHEN count(*) = count(satisfacao) THEN round(sum(satisfacao), 6) END
         AS "TOTAL_SATISFACAO",
       CASE WHEN count(*) = count(satisfacao) THEN round(avg(satisfacao), 6) END AS "MEDIA",
       CASE WHEN count(*) = count(satisfacao) THEN round(median(satisfacao), 6) END AS "MEDIANA"
FROM c GROUP BY 1"""))
def _(spark, d):
    composite = sat.composite_satisfaction(b.raw_general(spark, d))
    return _rounded(sat.satisfaction_by_period(composite, strict_nulls=True))


@query("satisfaction_table_for_year", S.with_("raw_general", extra=(COMPOSITE_SQL,), select=f"""
SELECT {S.array(fv.MONTHS_SHORT)}[month("PERIODO")] || '/1999' AS "PERIODO", {_STATS}
FROM c WHERE year("PERIODO") = 1999 GROUP BY 1"""))
def _(spark, d):
    composite = sat.composite_satisfaction(b.raw_general(spark, d))
    return _rounded(sat.satisfaction_table_for_year(composite, 1999))


_MONTH = f"CASE WHEN mes_texto IN {tuple(fv.MONTHS)} THEN mes_texto END"
_RECEPTION = f"""t AS (
  SELECT ano_consolidacao AS "ANO", {_MONTH} AS "MES", count(*) AS "N_RESPOSTAS",
         {S.count_if("recepcao IN ('Bom', 'Ótimo')")} AS "BOM_OTIMO",
         CAST(sum({S.fifths("recepcao")}) / 5.0 AS DOUBLE) AS "SCORE_TOTAL"
  FROM ra WHERE ano_consolidacao >= 1996 AND {S.fifths("recepcao")} > 0 GROUP BY ALL),
u AS (SELECT *, {S.half_even('"SCORE_TOTAL" / "N_RESPOSTAS" * 100', 1)} AS "FREQ",
             "ANO" || '/' || "MES" AS "PERIODO" FROM t)"""


@query("reception_frequency", S.with_("raw_ambulatory", extra=(_RECEPTION,), select=f"""
SELECT *, round(100.0::DOUBLE - "FREQ", 6) AS "PERDA", {S.percent('"FREQ"', 1)} AS "PROP" FROM u"""))
def _(spark, d):
    out = sat.reception_frequency(b.raw_ambulatory(spark, d), min_year=1996)
    return out.withColumn("PERDA", F.round("PERDA", 6))


@query("reception_share", S.with_("raw_ambulatory", extra=(_RECEPTION,), select="""
SELECT "ANO", "MES", "PERIODO", 'FREQ' AS variable, round("FREQ", 6) AS value,
       round("FREQ" / 100, 6) AS share FROM u
UNION ALL
SELECT "ANO", "MES", "PERIODO", 'PERDA', round(100.0::DOUBLE - "FREQ", 6),
       round((100.0::DOUBLE - "FREQ") / 100, 6) FROM u"""))
def _(spark, d):
    frequency = sat.reception_frequency(b.raw_ambulatory(spark, d), min_year=1996)
    out = sat.reception_share(frequency)
    return out.withColumns({c: F.round(c, 6) for c in ("value", "share")})


@query("score_distribution_for_year", S.with_("raw_general", select=f"""
SELECT {S.score("h_2")} AS score, count(*) AS n FROM rg WHERE ano_consolidacao = 1999 GROUP BY 1"""))
def _(spark, d):
    return sat.score_distribution_for_year(b.raw_general(spark, d), 1999)


@query("month_answer_crosstab", S.with_("raw_general", select="SELECT mes_texto AS mes_consolidacao, "
    + ", ".join(S.count_if(f"h_2 = {S.lit(x)}") + f' AS "{x}"' for x in fv.RECEPTION_ANSWERS)
    + " FROM rg WHERE ano_consolidacao = 1999 AND h_2 IS NOT NULL GROUP BY 1"))
def _(spark, d):
    return sat.month_answer_crosstab(b.raw_general(spark, d), 1999)


@query("answer_frequency", S.with_("raw_ambulatory", select="""
SELECT recepcao AS resposta, count(*) AS n FROM ra WHERE recepcao IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    return sat.answer_frequency(b.raw_ambulatory(spark, d), "recepcao")


@query("distinct_answers", S.with_("raw_general", select=f"""
SELECT DISTINCT a_1 AS resposta, {S.score("a_1")} AS score FROM rg"""))
def _(spark, d):
    return sat.distinct_answers(b.raw_general(spark, d), "a_1")


# --- Ratings and sectors -------------------------------------------------------------------------


def _rating_counts(column: str) -> str:
    return ", ".join(f'{S.count_if(f"{column} = {i}")} AS "{label}"'
                     for i, label in enumerate(fv.RATING_LABELS, start=1))


@query("rating_by_question", S.with_("general", select=f"""
SELECT {S.KEYS}, x, {_rating_counts("r")} FROM (
  SELECT {S.KEYS}, unnest({S.array(S.Q)}) AS x, unnest([{", ".join(S.Q)}]) AS r FROM g)
WHERE r IS NOT NULL GROUP BY ALL"""))
def _(spark, d):
    return ratings.rating_by_question(b.general(spark, d))


@query("rating_by_question_ambulatory", S.with_("ambulatory", select=f"""
SELECT {S.KEYS}, x, {_rating_counts("r")} FROM (
  SELECT {S.KEYS}, unnest(['recepcao', 'medico']) AS x, unnest([recepcao, medico]) AS r FROM a)
WHERE r IS NOT NULL GROUP BY ALL"""))
def _(spark, d):
    return ratings.rating_by_question(b.ambulatory(spark, d), fv.AMBULATORY_QUESTIONS)


@query("rating_distribution_general", S.with_("general", select=f"""
SELECT {S.KEYS}, {S.array(fv.RATING_LABELS)}[r] AS avaliacao, n AS freq,
       {S.r6(f"100.0 * n / sum(n) OVER (PARTITION BY {S.KEYS})")} AS fr
FROM (SELECT {S.KEYS}, r, count(*) AS n
      FROM (SELECT {S.KEYS}, unnest([{", ".join(S.Q)}]) AS r FROM g)
      WHERE r IS NOT NULL GROUP BY ALL)"""))
def _(spark, d):
    out = ratings.rating_distribution_general(b.general(spark, d))
    return out.withColumn("fr", F.round("fr", 6))


@query("sector_form_counts", S.with_("general", "ambulatory", select=f"""
SELECT {S.KEYS}, setor, CAST(sum(w) AS BIGINT) AS qtde FROM (
  SELECT {S.KEYS}, coalesce(nullif(setor, ''), 'Não informado') AS setor, 1 AS w FROM g
  UNION ALL SELECT DISTINCT {S.KEYS}, 'Ambulatório', 0 FROM g
  UNION ALL SELECT {S.KEYS}, 'Ambulatório', 1 FROM a) GROUP BY ALL"""))
def _(spark, d):
    return ratings.sector_form_counts(b.general(spark, d), b.ambulatory(spark, d))


# --- Comments ------------------------------------------------------------------------------------

_ALL_COMMENTS = f"""
SELECT {S.KEYS}, kind, autorizo, nome, contato, texto FROM cg WHERE {S.trim_ws("texto")} <> ''
UNION ALL
SELECT {S.KEYS}, kind, autorizo, nome, contato, texto FROM ca WHERE {S.trim_ws("texto")} <> '' """
_DISTINCT_COMMENTS = f"""
SELECT DISTINCT {S.KEYS}, kind, {S.trim_ws("texto")} AS texto
FROM (SELECT {S.KEYS}, kind, texto FROM cg UNION ALL SELECT {S.KEYS}, kind, texto FROM ca)
WHERE {S.trim_ws("texto")} <> '' """


@query("extract_comments", S.with_("comments", select=_ALL_COMMENTS))
def _(spark, d):
    return comments.extract_comments(b.raw_comment_general(spark, d),
                                     b.raw_comment_ambulatory(spark, d))


@query("extract_comments_distinct", S.with_("comments", select=_DISTINCT_COMMENTS))
def _(spark, d):
    return comments.extract_comments_distinct(b.raw_comment_general(spark, d),
                                              b.raw_comment_ambulatory(spark, d))


@query("comment_counts", S.with_("comments", select=f"""
SELECT kind, CAST(sum(every) AS BIGINT) AS every, CAST(sum(once) AS BIGINT) AS once FROM (
  SELECT kind, 1 AS every, 0 AS once FROM ({_ALL_COMMENTS})
  UNION ALL SELECT kind, 0, 1 FROM ({_DISTINCT_COMMENTS})) GROUP BY kind"""))
def _(spark, d):
    general, ambulatory = b.raw_comment_general(spark, d), b.raw_comment_ambulatory(spark, d)
    every = comments.extract_comments(general, ambulatory).select(
        "kind", F.lit(1).alias("every"), F.lit(0).alias("once"))
    once = comments.extract_comments_distinct(general, ambulatory).select(
        "kind", F.lit(0).alias("every"), F.lit(1).alias("once"))
    return reshape.column_totals(every.unionByName(once), ["every", "once"], ["kind"])
