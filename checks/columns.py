"""Queries for the projections and normalisation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import query
from formpulse import fixed_values as fv
from formpulse import functions as fn
from formpulse.functions import dates, nps, ratings, text
from formpulse.operators import manifestations as mf
from formpulse.operators import satisfaction as sat
from formpulse.sources import bindings as b
from formpulse.sources import csv, normalize
from formpulse.sources.bundle import means_projection

RAW_COLUMNS_SQL = f"""
  strftime(d, '%d/%m/%Y %H:%M:%S') AS data, nome,
  strftime(internacao, '%d/%m/%Y') AS data_internacao,
  coalesce(strftime(alta, '%d/%m/%Y'), 'xx') AS data_alta, contato, autorizo, setor,
  {", ".join(S.Q)}, elogios, sugestoes, reclamacoes, mes_texto AS mes_consolidacao,
  CAST(k AS VARCHAR) AS id, CAST(ano_consolidacao AS VARCHAR) AS ano_consolidacao,
  'Sim' AS pesquisa_ativa, equipe_pesquisa, CAST(nps AS VARCHAR) AS nps,
  CAST(NULL AS VARCHAR) AS quando_queixa, CAST(NULL AS VARCHAR) AS periodo_queixa"""


@query("rename_positional", S.with_("raw_general", select=f"SELECT {RAW_COLUMNS_SQL} FROM rg"))
def _(spark, d):
    raw = b.raw_general(spark, d)
    unnamed = raw.toDF(*(f"X{i}" for i in range(len(raw.columns))))
    return csv.rename_positional(unnamed, "general46")


@query("likert_ordinal", S.with_("raw_general", select="SELECT k AS id, " + ", ".join(
    f"{S.ordinal(q)} AS {q}" for q in S.Q) + " FROM rg"))
def _(spark, d):
    raw = b.raw_general(spark, d)
    return raw.select(text.cast_id(F.col("id")).alias("id"),
                      *(ratings.likert_ordinal(q).alias(q) for q in fv.QUESTIONS))


@query("likert_score", S.with_("raw_general", select="SELECT k AS id, " + ", ".join(
    f"{S.score(q)} AS {q}" for q in S.Q) + " FROM rg"))
def _(spark, d):
    raw = b.raw_general(spark, d)
    return raw.select(text.cast_id(F.col("id")).alias("id"),
                      *(ratings.likert_score(q).alias(q) for q in fv.QUESTIONS))


_LABEL = "CASE {x} WHEN 1 THEN 'Ruim' WHEN 2 THEN 'Regular' WHEN 3 THEN 'Bom' WHEN 4 THEN 'Otimo'"


@query("rating_label", S.with_("ambulatory", select=(
    f"SELECT id, {_LABEL.format(x='recepcao')} END AS recepcao, "
    f"{_LABEL.format(x='medico')} ELSE 'Nda' END AS medico FROM a")))
def _(spark, d):
    forms = b.ambulatory(spark, d)
    return forms.select("id", fn.rating_label(F.col("recepcao")).alias("recepcao"),
                        fn.rating_label(F.col("medico"), other="Nda").alias("medico"))


_MEANS = [f"m_{x}" for x in fv.BLOCK_SIZES]


@query("block_means", S.with_("general", select=f"SELECT id, {', '.join(_MEANS)} FROM g"))
def _(spark, d):
    return b.general(spark, d).select("id", *_MEANS)


@query("mean_of_means", S.with_("general", select=f"SELECT id, {S.r6('m_x')} AS m_x FROM g"))
def _(spark, d):
    return b.general(spark, d).select("id", F.round("m_x", 6).alias("m_x"))


@query("ambulatory_mean", S.with_("ambulatory", select="SELECT id, m FROM a"))
def _(spark, d):
    return b.ambulatory(spark, d).select("id", "m")


@query("means_projection", S.with_("general", "ambulatory", select=f"""
SELECT 'consolidated' AS rule, ano_consolidacao AS ano, mes_consolidacao AS mes,
       {", ".join(_MEANS)}, {S.r6("m_x")} AS m_x, NULL AS recepcao, NULL AS medico, NULL AS m FROM g
UNION ALL
SELECT 'dated', ano, CAST(mes AS VARCHAR), {", ".join(_MEANS)}, {S.r6("m_x")}, NULL, NULL, NULL
FROM g
UNION ALL
SELECT 'consolidated', ano_consolidacao, mes_consolidacao, {", ".join("NULL" for _ in _MEANS)},
       NULL, recepcao, medico, m FROM a"""))
def _(spark, d):
    general, ambulatory = b.general(spark, d), b.ambulatory(spark, d)

    def tagged(df, rule):
        df = df.withColumn("mes", F.col("mes").cast("string"))
        return df.withColumn("rule", F.lit(rule))

    both = tagged(means_projection(general), "consolidated").unionByName(
        tagged(means_projection(general, by_date=True), "dated")
    ).unionByName(tagged(means_projection(ambulatory), "consolidated"), allowMissingColumns=True)
    return both.withColumn("m_x", F.round("m_x", 6))


@query("parse_survey_timestamp", S.with_("raw_general", select="SELECT k AS id, d AS data FROM rg"))
def _(spark, d):
    raw = b.raw_general(spark, d)
    return raw.select(text.cast_id(F.col("id")).alias("id"),
                      dates.parse_survey_timestamp(F.col("data")).alias("data"))


@query("parse_survey_date", S.with_("raw_general", select="""
SELECT k AS id, CAST(internacao AS DATE) AS data_internacao, CAST(alta AS DATE) AS data_alta
FROM rg"""))
def _(spark, d):
    raw = b.raw_general(spark, d)
    return raw.select(text.cast_id(F.col("id")).alias("id"),
                      *(dates.parse_survey_date(F.col(c)).alias(c)
                        for c in ("data_internacao", "data_alta")))


@query("derive_period", """
SELECT event_id, CAST(ts AS DATE) AS dia, CAST(year(ts) AS INTEGER) AS ano,
       CAST(month(ts) AS INTEGER) AS mes, strftime(ts, '%Y/%m') AS periodo FROM events""")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select("event_id", *(c.alias(n) for n, c in
                                       dates.derive_period(F.col("ts")).items()))


@query("month_ordinal", S.with_("raw_general", select=f"""
SELECT k AS id, {S.month_ordinal("mes_texto")} AS ordinal,
       {S.array(fv.MONTHS_SHORT)}[{S.month_ordinal("mes_texto")}] AS curto FROM rg"""))
def _(spark, d):
    raw = b.raw_general(spark, d)
    ordinal = dates.month_ordinal(F.col("mes_consolidacao"))
    return raw.select(text.cast_id(F.col("id")).alias("id"), ordinal.alias("ordinal"),
                      dates.month_name(ordinal, short=True).alias("curto"))


@query("period_from_parts", S.with_("raw_general", select=f"""
SELECT k AS id, make_date(ano_consolidacao, {S.month_ordinal("mes_texto")}, 1) AS periodo,
       {S.array(fv.MONTHS_SHORT)}[{S.month_ordinal("mes_texto")}] || '/' || ano_consolidacao
         AS rotulo FROM rg"""))
def _(spark, d):
    raw = b.raw_general(spark, d)
    first = dates.period_from_parts(F.col("ano_consolidacao").try_cast("int"),
                                    F.col("mes_consolidacao"))
    return raw.select(text.cast_id(F.col("id")).alias("id"), first.alias("periodo"),
                      dates.period_label(first).alias("rotulo"))


def _order_key(raw):
    """The order key inside the raw texts: the digits of whichever text is given."""
    digits = F.regexp_extract(F.coalesce("elogio", "sugestao", "reclamacao"), r"(\d+)$", 1)
    return F.nullif(digits, F.lit("")).cast("bigint").alias("id")


# The raw layout has no id; it is taken from the given text, and missing where none is given.
_RM_ID = "CASE WHEN coalesce(elogio, sugestao, reclamacao) IS NOT NULL THEN k END AS id"


@query("normalize_sector", S.with_("raw_manifestations", select=(
    f"SELECT {_RM_ID}, upper(trim(setor)) AS setor FROM rm")))
def _(spark, d):
    raw = b.raw_manifestations(spark, d)
    return raw.select(_order_key(raw), fn.normalize_sector(F.col("setor")).alias("setor"))


@query("normalize_name", S.with_("raw_manifestations", select=(
    f"SELECT {_RM_ID}, {S.TITLE.format(x='nome')} AS nome FROM rm")))
def _(spark, d):
    raw = b.raw_manifestations(spark, d)
    return raw.select(_order_key(raw), fn.normalize_name(F.col("nome")).alias("nome"))


@query("normalize_email", S.with_("raw_manifestations", select=(
    f"SELECT {_RM_ID}, lower(trim(email)) AS email FROM rm")))
def _(spark, d):
    raw = b.raw_manifestations(spark, d)
    return raw.select(_order_key(raw), fn.normalize_email(F.col("email")).alias("email"))


@query("normalize_phone", S.with_("raw_manifestations", select=(
    f"SELECT {_RM_ID}, regexp_replace(telefone, '[^0-9]', '', 'g') AS telefone FROM rm")))
def _(spark, d):
    raw = b.raw_manifestations(spark, d)
    return raw.select(_order_key(raw), fn.normalize_phone(F.col("telefone")).alias("telefone"))


@query("trim_ws", f"""
SELECT conv_id, turn, {S.trim_ws("' ' || chr(9) || text || chr(10) || ' '")} AS texto
FROM conversations""")
def _(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    padded = F.concat(F.lit(" \t"), F.col("text"), F.lit("\n "))
    return turns.select("conv_id", "turn", fn.trim_ws(padded).alias("texto"))


@query("normalize_consent", S.with_("raw_general", select=(
    "SELECT k AS id, lower(autorizo) AS autorizo FROM rg")))
def _(spark, d):
    raw = b.raw_general(spark, d)
    return raw.select(text.cast_id(F.col("id")).alias("id"),
                      fn.normalize_consent(F.col("autorizo")).alias("autorizo"))


@query("cast_id", S.with_("raw_general", select="""
SELECT k AS id, TRY_CAST(CASE WHEN k % 7 = 0 THEN 'n/d' ELSE CAST(k AS VARCHAR) END AS BIGINT)
  AS id_numerico FROM rg"""))
def _(spark, d):
    raw = b.raw_general(spark, d)
    key = text.cast_id(F.col("id"))
    dirty = F.when(key % 7 == 0, "n/d").otherwise(F.col("id"))
    return raw.select(key.alias("id"), text.cast_id(dirty).alias("id_numerico"))


@query("prefix_id", S.with_("general", "ambulatory", select="""
SELECT 'G.' || id AS id FROM g UNION ALL SELECT 'A.' || id FROM a"""))
def _(spark, d):
    general, ambulatory = b.general(spark, d), b.ambulatory(spark, d)
    return general.select(fn.prefix_id(F.col("id"), fv.ID_PREFIX_GENERAL).alias("id")).union(
        ambulatory.select(fn.prefix_id(F.col("id"), fv.ID_PREFIX_AMBULATORY)))


@query("manifestation_type", S.with_("raw_manifestations", select=(
    f"SELECT {_RM_ID}, {S.TYPE} AS tipo FROM rm")))
def _(spark, d):
    raw = b.raw_manifestations(spark, d)
    kind = fn.manifestation_type(*map(F.col, fv.MANIFESTATION_TYPES[:3]))
    return raw.select(_order_key(raw), kind.alias("tipo"))


@query("manifestation_text", S.with_("raw_manifestations", select=(
    f"SELECT {_RM_ID}, coalesce(elogio, sugestao, reclamacao, '-') AS manifestacao FROM rm")))
def _(spark, d):
    raw = b.raw_manifestations(spark, d)
    body = fn.manifestation_text(*map(F.col, fv.MANIFESTATION_TYPES[:3]))
    return raw.select(_order_key(raw), body.alias("manifestacao"))


_V1_DROP = f"CASE WHEN nps IS NOT NULL THEN {S.class_v1('nps')} END"


@query("nps_class", S.with_("general", select=f"""
SELECT id, nps, {_V1_DROP} AS v1, CASE WHEN nps IS NULL THEN 'neutro' ELSE {S.CLASS_V2} END
  AS v2_neutral, {S.CLASS_V2} AS v2_detractor FROM g"""))
def _(spark, d):
    score = F.col("nps")
    return b.general(spark, d).select(
        "id", "nps", nps.nps_class(score, style="v1").alias("v1"),
        nps.nps_class(score, null_score="neutral").alias("v2_neutral"),
        nps.nps_class(score, null_score="detractor").alias("v2_detractor"))


@query("nps_sign", S.with_("general", select=f"""
SELECT id, CASE WHEN nps IS NOT NULL THEN {S.sign("nps")} END AS dropped,
       {S.sign("nps")} AS neutral FROM g"""))
def _(spark, d):
    score = F.col("nps")
    return b.general(spark, d).select(
        "id", nps.nps_sign(score).alias("dropped"),
        nps.nps_sign(score, null_score="neutral").alias("neutral"))


@query("nps_flag", S.with_("manifestations", select=(
    "SELECT dia, setor, classe, flag, count(*) AS n FROM m GROUP BY ALL")))
def _(spark, d):
    rows = b.manifestations(spark, d).withColumn("flag", fn.nps_flag(F.col("classe")))
    return rows.groupBy("dia", "setor", "classe", "flag").agg(F.count("*").alias("n"))


@query("nps_zone", f"""
SELECT id, score, {S.zone_v1("score")} AS v1, {S.zone_v2("score")} AS v2
FROM (SELECT o_orderkey AS id,
             CAST((o_orderkey * 7 + o_custkey) % 401 - 200 AS DOUBLE) / 2 AS score FROM orders)""")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    value = ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 401 - 200).cast("double") / 2
    return orders.select(F.col("o_orderkey").alias("id"), value.alias("score")).select(
        "id", "score", nps.nps_zone(F.col("score"), policy="v1").alias("v1"),
        nps.nps_zone(F.col("score"), policy="v2").alias("v2"))


_FIFTHS = [S.fifths(q) if q else "0" for q in fv.COMPOSITE_QUESTIONS]
COMPOSITE_SQL = f"""c0 AS (
  SELECT k AS id, make_date(ano_consolidacao, {S.month_ordinal("mes_texto")}, 1) AS "PERIODO",
         {", ".join(f'{x} AS s{i:02d}' for i, x in enumerate(_FIFTHS, 1))} FROM rg),
c1 AS (
  SELECT *, {" + ".join(f"s{i:02d}" for i in range(1, 14))} AS total,
         {" + ".join(f"CAST(s{i:02d} > 0 AS INTEGER)" for i in range(1, 14))} AS qtd FROM c0),
c AS (
  SELECT *, CAST(CASE WHEN qtd > 0 THEN total / (qtd * 5.0) WHEN qtd = 0 THEN 0 END AS DOUBLE)
    AS satisfacao FROM c1)"""
_BAND = ("CASE WHEN satisfacao >= 0.8 THEN 'BOM/OTIMO' WHEN satisfacao = 0 THEN 'NULO' "
         "WHEN satisfacao IS NOT NULL THEN 'BAIXO' END")


@query("composite_satisfaction", S.with_("raw_general", extra=(COMPOSITE_SQL,), select=f"""
SELECT "PERIODO", {", ".join(f'CAST(s{i:02d} / 5.0 AS DOUBLE) AS "S{i:02d}"'
                             for i in range(1, 14))},
       CAST(total / 5.0 AS DOUBLE) AS "SGERAL", CAST(qtd AS INTEGER) AS "QTD_RESP",
       round(satisfacao, 9) AS "SATISFACAO", {_BAND} AS "S" FROM c"""))
def _(spark, d):
    rows = sat.composite_satisfaction(b.raw_general(spark, d))
    return rows.withColumn("SATISFACAO", F.round("SATISFACAO", 9))


@query("satisfaction_band", S.with_("raw_general", extra=(COMPOSITE_SQL,), select=f"""
SELECT {_BAND} AS "S", count(*) AS n FROM c GROUP BY 1"""))
def _(spark, d):
    rows = sat.composite_satisfaction(b.raw_general(spark, d))
    band = fn.satisfaction_band(F.col("SATISFACAO")).alias("S")
    return rows.select(band).groupBy("S").agg(F.count("*").alias("n"))


AMBULATORY_SQL = f"""s AS (
  SELECT ano_consolidacao AS "ANO",
         CASE WHEN mes_texto IN {tuple(fv.MONTHS)} THEN mes_texto END AS "MES", k AS "ID",
         atendente AS "ATENDENTE", {S.score("recepcao")} AS r, {S.score("medico")} AS m,
         {S.sign("nps")} AS "NPS" FROM ra WHERE ano_consolidacao >= 1997)"""


@query("ambulatory_satisfaction", S.with_("raw_ambulatory", extra=(AMBULATORY_SQL,), select="""
SELECT "ANO", "MES", "ID", "ATENDENTE", r AS "RECEPCAO", m AS "MEDICO",
       round(CASE WHEN r = 0 AND m IS NULL THEN NULL WHEN r IS NULL THEN NULL
            WHEN r > 0 AND m IS NULL THEN NULL
            WHEN r > 0 AND m > 0 THEN (r + m) / 2 WHEN r > 0 THEN r ELSE m END, 9) AS "SATISFACAO",
       "NPS" FROM s"""))
def _(spark, d):
    rows = sat.ambulatory_satisfaction(b.raw_ambulatory(spark, d), min_year=1997)
    return rows.withColumn("SATISFACAO", F.round("SATISFACAO", 9))


_CLEAN = ", ".join(fv.CLEAN_COLUMNS)


@query("select_clean_columns", S.with_("manifestations", select=f"SELECT {_CLEAN} FROM m"))
def _(spark, d):
    return normalize.select_clean_columns(b.manifestations(spark, d))


@query("fill_missing_dash", S.with_("raw_manifestations", select="""
SELECT strftime(d, '%d/%m/%Y %H:%M:%S') AS data, setor, nps, 'outro' AS tipo,
       coalesce(elogio, '-') AS elogio, coalesce(sugestao, '-') AS sugestao,
       coalesce(reclamacao, '-') AS reclamacao, coalesce(nome, '-') AS nome,
       coalesce(telefone, '-') AS telefone, coalesce(email, '-') AS email FROM rm"""))
def _(spark, d):
    raw = b.raw_manifestations(spark, d)
    return normalize.fill_missing_dash(raw.withColumn("nps", F.col("nps").try_cast("int")))


_SHARE = "(CAST(CAST(n AS DOUBLE) / t AS DOUBLE) * 100)"


@query("percent_label", S.with_("manifestations", select=f"""
SELECT periodo, setor, {S.percent(_SHARE, 1)} AS one, {S.percent(_SHARE, 2)} AS two,
       {S.percent(_SHARE, 2, True)} AS fixed
FROM (SELECT periodo, setor, n, sum(n) OVER (PARTITION BY periodo) AS t
      FROM (SELECT periodo, setor, count(*) AS n FROM m GROUP BY ALL))"""))
def _(spark, d):
    from formpulse.functions.numbers import share
    from formpulse.operators.keys import with_group_total

    counts = with_group_total(mf.sector_counts(b.manifestations(spark, d)), "n", ["periodo"], "t")
    value = share(F.col("n"), F.col("t")) * 100
    return counts.select("periodo", "setor", fn.percent_label(value, 1).alias("one"),
                         fn.percent_label(value, 2).alias("two"),
                         fn.percent_label(value, 2, fixed=True).alias("fixed"))


@query("drop_display_columns", S.with_("manifestations", select="""
SELECT strftime(data, '%d/%m/%Y %H:%M:%S') AS data, setor, nps, classe, flag, tipo, manifestacao,
       nome, telefone, email FROM m"""))
def _(spark, d):
    return mf.drop_display_columns(b.manifestations(spark, d))


@query("rename_display", S.with_("pivot", select=f"""
SELECT periodo, setor, elogio AS "elogios", sugestao AS "sugestões", reclamacao AS "reclamações",
       preferiu_nao_informar AS "não informou", total,
       {S.percent("prop * 100", 2, True)} AS "% proporção"
FROM (SELECT *, {S.half_even("CAST(total AS DOUBLE) / sum(total) OVER (PARTITION BY periodo)", 4)}
      AS prop FROM p)"""))
def _(spark, d):
    return mf.rename_display(mf.sector_share(mf.period_sector_pivot(b.manifestations(spark, d))))


_GENERAL_COLUMNS = f"""id, data, nome, data_internacao, data_alta, contato, autorizo, setor,
  {", ".join(S.Q)}, elogios, sugestoes, reclamacoes, ano_consolidacao, mes_consolidacao,
  mes_ordinal, equipe_pesquisa, nps, ano, mes, {", ".join(_MEANS)}, {S.r6("m_x")} AS m_x"""


@query("normalize_general", S.with_("general", select=f"""
SELECT {_GENERAL_COLUMNS}, 'Sim' AS pesquisa_ativa, CAST(NULL AS VARCHAR) AS quando_queixa,
       CAST(NULL AS VARCHAR) AS periodo_queixa FROM g WHERE ano >= 1996"""))
def _(spark, d):
    forms = normalize.normalize_general(b.raw_general(spark, d), min_year=1996)
    return forms.withColumn("m_x", F.round("m_x", 6))


@query("normalize_ambulatory", S.with_("ambulatory", select="""
SELECT id, data, nome, contato, recepcao, medico, elogios, sugestoes, reclamacoes, atendente,
       ano_consolidacao, mes_consolidacao, mes_ordinal, nps, ano, mes, m FROM a"""))
def _(spark, d):
    return b.ambulatory(spark, d)


@query("clean_manifestations", S.with_("manifestations", select=f"SELECT {_CLEAN} FROM m"))
def _(spark, d):
    return b.manifestations(spark, d)
