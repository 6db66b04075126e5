"""Queries for filters, joins, distinct lists, sorts and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import query
from formpulse import fixed_values as fv
from formpulse.operators import calendar as cal
from formpulse.operators import manifestations as mf
from formpulse.operators import nps, periods, ratings, reshape
from formpulse.operators import attendants as att
from formpulse.operators.keys import CONSOLIDATION
from formpulse.sources import bindings as b

CAL = S.calendar(1996, 2001)


def calendar(spark):
    """A calendar that leaves the first years of the forms unmatched."""
    return cal.calendar_dimension(spark, 1996, 2001)


# --- Filters ---------------------------------------------------------------------------------


@query("filter_period", S.with_("general", select="""
SELECT id, data, setor, nps FROM g
WHERE ano_consolidacao = 1997 AND mes_consolidacao = 'Agosto'"""))
def _(spark, d):
    forms = periods.filter_period(b.general(spark, d), 1997, "Agosto")
    return forms.select("id", "data", "setor", "nps")


@query("filter_period_by_date", S.with_("general", select="""
SELECT id, data, setor, nps FROM g WHERE ano = 1998 AND mes_consolidacao = 'Dezembro'"""))
def _(spark, d):
    forms = periods.filter_period_by_date(b.general(spark, d), 1998, "Dezembro")
    return forms.select("id", "data", "setor", "nps")


@query("filter_period_key", S.with_("manifestations", select=f"""
SELECT {", ".join(fv.CLEAN_COLUMNS)} FROM m WHERE periodo = '1997/08'"""))
def _(spark, d):
    return periods.filter_period_key(b.manifestations(spark, d), "1997/08")


@query("filter_year", S.with_("general", select="""
SELECT 'one' AS rule, id FROM g WHERE ano_consolidacao = 1999
UNION ALL SELECT 'since', id FROM g WHERE ano_consolidacao >= 2000
UNION ALL SELECT 'dated since', id FROM g WHERE ano >= 2000"""))
def _(spark, d):
    forms = b.general(spark, d)
    parts = {
        "one": periods.filter_year(forms, 1999),
        "since": periods.filter_year(forms, min_year=2000),
        "dated since": periods.filter_year(forms, min_year=2000, column="ano"),
    }
    one, since, dated = (df.select(F.lit(r).alias("rule"), "id") for r, df in parts.items())
    return one.unionByName(since).unionByName(dated)


@query("filter_quarter", S.with_("nps_rows", extra=(CAL,), select="""
SELECT n."ID", n."ORIGEM", n."NOTA", cal."PERIODO_CURTO"
FROM n JOIN cal ON n."ANO" = cal."ANO" AND n."MES" = cal."MES"
WHERE cal."ID_TRIMESTRE" = '1999.Q3'"""))
def _(spark, d):
    rows = nps.nps_rows(b.general(spark, d), b.ambulatory(spark, d))
    chosen = periods.filter_quarter(cal.join_calendar(rows, calendar(spark)), "1999.Q3")
    return chosen.select("ID", "ORIGEM", "NOTA", "PERIODO_CURTO")


@query("filter_month_in", S.with_("ambulatory", select="""
SELECT id, mes_consolidacao, nps FROM a
WHERE mes_consolidacao IN ('Outubro', 'Novembro', 'Dezembro')"""))
def _(spark, d):
    forms = periods.filter_month_in(b.ambulatory(spark, d), fv.REFERENCE_MONTHS)
    return forms.select("id", "mes_consolidacao", "nps")


@query("drop_null_score", S.with_("general", select="""
SELECT id, nps, mes_consolidacao FROM g
WHERE nps IS NOT NULL AND mes_consolidacao IS NOT NULL"""))
def _(spark, d):
    forms = periods.drop_null_score(b.general(spark, d), "nps", "mes_consolidacao")
    return forms.select("id", "nps", "mes_consolidacao")


@query("answered_only", S.with_("raw_ambulatory", select=f"""
SELECT k AS id, recepcao, {S.score("recepcao")} AS score FROM ra
WHERE recepcao IS NOT NULL AND {S.score("recepcao")} > 0"""))
def _(spark, d):
    from formpulse.functions import likert_score

    raw = b.raw_ambulatory(spark, d)
    scored = raw.select(F.col("id").cast("bigint").alias("id"), "recepcao",
                        likert_score("recepcao").alias("score"))
    return periods.answered_only(scored, "recepcao", "score")


@query("has_comment", S.with_("general", select=f"""
SELECT 'elogios' AS kind, id, elogios AS texto FROM g WHERE {S.trim_ws("elogios")} <> ''
UNION ALL
SELECT 'sugestoes', id, sugestoes FROM g WHERE {S.trim_ws("sugestoes")} <> ''
UNION ALL
SELECT 'reclamacoes', id, reclamacoes FROM g WHERE {S.trim_ws("reclamacoes")} <> ''"""))
def _(spark, d):
    forms = b.general(spark, d)
    praise, ideas, complaints = (
        periods.with_comment(forms, kind).select(F.lit(kind).alias("kind"), "id",
                                                 F.col(kind).alias("texto"))
        for kind in fv.COMMENT_KINDS
    )
    return praise.unionByName(ideas).unionByName(complaints)


@query("complete_cases", S.with_("ambulatory", select="""
SELECT ano_consolidacao, mes_consolidacao, atendente, recepcao, medico, nps FROM a
WHERE mes_consolidacao IS NOT NULL AND atendente IS NOT NULL AND recepcao IS NOT NULL
  AND medico IS NOT NULL AND nps IS NOT NULL"""))
def _(spark, d):
    forms = b.ambulatory(spark, d).select(*CONSOLIDATION, "atendente", "recepcao", "medico", "nps")
    return periods.complete_cases(forms)


_LISTING = ", ".join(c for c in fv.CLEAN_COLUMNS if c != "tipo")


@query("filter_by_type", S.with_("manifestations", select=f"""
SELECT {_LISTING} FROM m WHERE tipo = 'sugestao'"""))
def _(spark, d):
    return periods.filter_by_type(b.manifestations(spark, d), "sugestao")


@query("filter_by_sector", S.with_("manifestations", select=f"""
SELECT {", ".join(c for c in fv.CLEAN_COLUMNS if c != "setor")} FROM m
WHERE setor = 'EMERGÊNCIA'"""))
def _(spark, d):
    return periods.filter_by_sector(b.manifestations(spark, d), "EMERGÊNCIA")


@query("subset_row_counts", S.with_("manifestations", select="""
SELECT periodo, 'tipo' AS subset, tipo AS value, count(*) AS n FROM m GROUP BY periodo, tipo
UNION ALL SELECT periodo, 'setor', setor, count(*) FROM m GROUP BY periodo, setor"""))
def _(spark, d):
    rows = b.manifestations(spark, d)
    kinds, sectors = (
        periods.subset_row_counts(rows, by).select("periodo", F.lit(by).alias("subset"),
                                                   F.col(by).alias("value"), "n")
        for by in ("tipo", "setor")
    )
    return kinds.unionByName(sectors)


@query("validate_period_args", S.with_("manifestations", select="""
SELECT periodo, tipo, count(*) AS n FROM m WHERE ano = 1999 AND mes = 8 GROUP BY ALL"""))
def _(spark, d):
    year, month = periods.validate_period_args(1999, "Agosto")
    wanted = f"{year}/{fv.MONTHS.index(month) + 1:02d}"
    rows = periods.filter_period_key(b.manifestations(spark, d), wanted)
    return periods.subset_row_counts(rows, "tipo")


@query("iterate_periods", S.with_("general", select="""
SELECT DISTINCT ano_consolidacao, mes_consolidacao FROM g"""))
def _(spark, d):
    return periods.iterate_periods(b.general(spark, d))


# --- Joins -------------------------------------------------------------------------------------


@query("join_calendar", S.with_("nps_rows", extra=(CAL,), select="""
SELECT n."ANO", n."MES", n."ORIGEM", n."ID", n."NOTA", n."CLASSE", n."NPS", cal."ID_TRIMESTRE",
       cal."SEMESTRE", cal."BIMESTRE", cal."PERIODO", cal."PERIODO_CURTO"
FROM n LEFT JOIN cal ON n."ANO" = cal."ANO" AND n."MES" = cal."MES" """))
def _(spark, d):
    rows = nps.nps_rows(b.general(spark, d), b.ambulatory(spark, d))
    return cal.join_calendar(rows, calendar(spark)).drop("MES_CURTO", "MES_ORDINAL", "TRIMESTRE")


@query("months_semi", S.with_("general", "ambulatory", select="""
SELECT id, ano_consolidacao, mes_consolidacao FROM g
WHERE EXISTS (
  SELECT 1 FROM a WHERE a.nps = 10 AND a.id % 7 = 0
    AND a.ano_consolidacao = g.ano_consolidacao AND a.mes_consolidacao = g.mes_consolidacao)"""))
def _(spark, d):
    months = b.ambulatory(spark, d).where("nps = 10 AND id % 7 = 0")
    forms = periods.months_semi(b.general(spark, d), months, CONSOLIDATION)
    return forms.select("id", *CONSOLIDATION)


@query("ordered_domain", S.with_("manifestations", select=f"""
SELECT classe, tipo, CAST(list_position({S.array(fv.NPS_CLASSES_V2)}, classe) AS INTEGER) AS o,
       count(*) AS n FROM m GROUP BY ALL"""))
def _(spark, d):
    rows = b.manifestations(spark, d)
    level = reshape.ordered_domain(F.col("classe"), fv.NPS_CLASSES_V2)
    return rows.groupBy("classe", "tipo", level.alias("o")).agg(F.count("*").alias("n"))


_BUCKETS = """h AS (
  SELECT ano_consolidacao, mes_consolidacao, 'x' AS form, CAST(ceil(list_avg([{q}])) AS INTEGER)
    AS r FROM g
  UNION ALL
  SELECT ano_consolidacao, mes_consolidacao, 'y', CAST(ceil(m) AS INTEGER) FROM a)""".format(
    q=", ".join(S.Q))
_ANSWERS = """h AS (
  SELECT ano_consolidacao, mes_consolidacao, 'x' AS form, unnest([{q}]) AS r FROM g
  UNION ALL
  SELECT ano_consolidacao, mes_consolidacao, 'y', unnest([recepcao, medico]) FROM a)""".format(
    q=", ".join(S.Q))
_MERGED = """t AS (
  SELECT ano_consolidacao, mes_consolidacao, r, count(*) FILTER (WHERE form = 'x') AS x,
         count(*) FILTER (WHERE form = 'y') AS y
  FROM h WHERE r IS NOT NULL GROUP BY ALL),
kept AS (SELECT * FROM t WHERE x > 0 AND y > 0)"""
_RATING = f"{S.array(fv.RATING_LABELS)}[r] AS avaliacao"


@query("merge_rating_totals", S.with_("general", "ambulatory", extra=(_ANSWERS, _MERGED), select=(
    f"SELECT {S.KEYS}, {_RATING}, x AS freq_x, y AS freq_y FROM kept")))
def _(spark, d):
    return ratings.merge_rating_totals(b.general(spark, d), b.ambulatory(spark, d))


@query("merge_mean_buckets", S.with_("general", "ambulatory", extra=(_BUCKETS, _MERGED), select=(
    f"SELECT {S.KEYS}, r AS bucket, x AS value_x, y AS value_y, x + y AS total FROM kept")))
def _(spark, d):
    return ratings.merge_mean_buckets(b.general(spark, d), b.ambulatory(spark, d))


@query("rating_distribution", S.with_("general", "ambulatory", extra=(_ANSWERS, _MERGED), select=f"""
SELECT {S.KEYS}, {_RATING}, x AS freq_x, y AS freq_y, x + y AS freq,
       {S.r6(f"100.0 * x / sum(x) OVER (PARTITION BY {S.KEYS})")} AS fr_x,
       {S.r6(f"100.0 * y / sum(y) OVER (PARTITION BY {S.KEYS})")} AS fr_y,
       {S.r6(f"100.0 * (x + y) / sum(x + y) OVER (PARTITION BY {S.KEYS})")} AS fr FROM kept"""))
def _(spark, d):
    out = ratings.rating_distribution(b.general(spark, d), b.ambulatory(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("fr_x", "fr_y", "fr")})


@query("mean_rating_histogram", S.with_("general", "ambulatory", extra=(_BUCKETS,), select=f"""
SELECT {S.KEYS}, CASE form WHEN 'x' THEN 'general' ELSE 'ambulatory' END AS form, r AS bucket,
       count(*) AS n FROM h WHERE r IS NOT NULL GROUP BY ALL"""))
def _(spark, d):
    return ratings.mean_rating_histogram(b.general(spark, d), b.ambulatory(spark, d))


@query("good_or_excellent_indicator", S.with_(
    "general", "ambulatory", extra=(_BUCKETS, _MERGED), select=f"""
SELECT k.ano_consolidacao, k.mes_consolidacao, CAST(1 AS INTEGER) AS ordinal,
       {S.lit(fv.INDICATOR_LABELS[0])} AS indicador,
       CAST(coalesce(sum(kept.x + kept.y), 0) AS BIGINT) AS resultado
FROM (SELECT DISTINCT {S.KEYS} FROM h) k LEFT JOIN kept
  ON k.ano_consolidacao = kept.ano_consolidacao
 AND k.mes_consolidacao IS NOT DISTINCT FROM kept.mes_consolidacao AND kept.r >= 3
GROUP BY ALL
UNION ALL
SELECT ano_consolidacao, mes_consolidacao, 2, {S.lit(fv.INDICATOR_LABELS[1])}, count(*)
FROM h GROUP BY ALL"""))
def _(spark, d):
    return ratings.good_or_excellent_indicator(b.general(spark, d), b.ambulatory(spark, d))


@query("attach_period_total", S.with_("pivot", select="""
SELECT *, CAST(sum(total) OVER (PARTITION BY periodo) AS BIGINT) AS n_periodo FROM p"""))
def _(spark, d):
    pivot = mf.period_sector_pivot(b.manifestations(spark, d))
    return mf.attach_period_total(pivot, mf.period_totals(pivot))


# --- Windows, sorts, reshaping -------------------------------------------------------------------


@query("rank_average_ties", """
WITH c AS (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderpriority, o_custkey, n,
       rank() OVER (PARTITION BY o_orderpriority ORDER BY n DESC)
         + (count(*) OVER (PARTITION BY o_orderpriority, n) - 1) / 2.0::DOUBLE AS "RANK" FROM c""")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    counts = orders.groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    return reshape.rank_average_ties(counts, "n", ["o_orderpriority"])


@query("share_of_total", S.with_("manifestations", select=f"""
SELECT periodo, tipo, n,
       {S.half_even("CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY periodo) * 100", 2)} AS fr
FROM (SELECT periodo, tipo, count(*) AS n FROM m GROUP BY ALL)"""))
def _(spark, d):
    counts = periods.subset_row_counts(b.manifestations(spark, d), "tipo")
    return reshape.share_of_total(counts, "n", ["periodo"], "fr", digits=2)


@query("sort_latest_first", S.with_("manifestations", select=f"""
SELECT {", ".join(fv.CLEAN_COLUMNS)} FROM m ORDER BY data DESC"""))
def _(spark, d):
    return mf.sort_latest_first(b.manifestations(spark, d))


@query("sort_period_sector", S.with_("pivot", select="SELECT * FROM p ORDER BY periodo, setor"))
def _(spark, d):
    return mf.sort_period_sector(mf.period_sector_pivot(b.manifestations(spark, d)))


@query("sort_by_count", S.with_("manifestations", select="""
SELECT periodo, setor, count(*) AS n FROM m GROUP BY ALL ORDER BY periodo, n DESC"""))
def _(spark, d):
    return mf.sort_by_count(mf.sector_counts(b.manifestations(spark, d)), "n", "periodo")


_RATED = """w AS (
  SELECT ano_consolidacao, mes_consolidacao, atendente,
         count(*) FILTER (WHERE recepcao = 3) AS "Bom",
         count(*) FILTER (WHERE recepcao = 4) AS "Otimo",
         count(*) FILTER (WHERE recepcao = 2) AS "Regular",
         count(*) FILTER (WHERE recepcao = 1) AS "Ruim", count(*) AS "QTDE_PESQUISADOS"
  FROM a WHERE atendente IS NOT NULL AND recepcao IS NOT NULL GROUP BY ALL)"""
_RANKED = f"""
SELECT *, rank() OVER (PARTITION BY {S.KEYS} ORDER BY "QTDE_PESQUISADOS" DESC)
  + (count(*) OVER (PARTITION BY {S.KEYS}, "QTDE_PESQUISADOS") - 1) / 2.0::DOUBLE AS "RANK" FROM w"""


@query("attendant_ratings", S.with_("ambulatory", extra=(_RATED,), select=(
    'SELECT * EXCLUDE ("QTDE_PESQUISADOS") FROM w')))
def _(spark, d):
    return att.attendant_ratings(b.ambulatory(spark, d))


@query("attendant_ranking", S.with_("ambulatory", extra=(_RATED,), select=_RANKED))
def _(spark, d):
    return att.attendant_ranking(b.ambulatory(spark, d))


@query("sort_by_rank", S.with_("ambulatory", extra=(_RATED,), select=(
    f'{_RANKED} ORDER BY {S.KEYS}, "RANK"')))
def _(spark, d):
    return mf.sort_by_rank(att.attendant_ranking(b.ambulatory(spark, d)), *CONSOLIDATION)


@query("attendant_ratings_trimmed", S.with_("ambulatory", select=f"""
SELECT {S.KEYS}, trim(atendente) AS atendente, {", ".join(
    f'count(*) FILTER (WHERE recepcao = {i}) AS "{label}"'
    for i, label in enumerate(fv.RATING_LABELS, 1))},
  count(*) FILTER (WHERE recepcao IS NULL) AS sem_nota
FROM a WHERE trim(atendente) <> '' AND mes_consolidacao IN ('Novembro', 'Dezembro')
GROUP BY ALL"""))
def _(spark, d):
    return att.attendant_ratings_trimmed(b.ambulatory(spark, d))


@query("domain_order", S.with_("general", select="""
SELECT ano_consolidacao, mes_consolidacao, count(*) AS n FROM g GROUP BY ALL"""))
def _(spark, d):
    counts = b.general(spark, d).groupBy(*CONSOLIDATION).agg(F.count("*").alias("n"))
    return reshape.domain_order(counts, "mes_consolidacao", fv.MONTHS, "ano_consolidacao")


@query("union_forms", S.with_("general", "ambulatory", select="""
SELECT 'GERAL' AS origem, 'G.' || id AS id, data, nps FROM g
UNION ALL SELECT 'AMBULATORIO', 'A.' || id, data, nps FROM a"""))
def _(spark, d):
    return reshape.union_forms(b.general(spark, d), b.ambulatory(spark, d),
                               ["id", "data", "nps"], prefix_ids=True)


@query("append_or_add_row", S.with_("general", "ambulatory", select="""
SELECT ano_consolidacao, setor, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT ano_consolidacao, setor, count(*) AS n FROM g GROUP BY ALL
  UNION ALL SELECT ano_consolidacao, 'Ambulatório', count(*) FROM a GROUP BY ALL) GROUP BY ALL"""))
def _(spark, d):
    keys = ["ano_consolidacao", "setor"]
    counts = b.general(spark, d).groupBy(*keys).agg(F.count("*").alias("n"))
    extra = b.ambulatory(spark, d).groupBy("ano_consolidacao").agg(F.count("*").alias("n"))
    extra = extra.withColumn("setor", F.lit(fv.SECTOR_AMBULATORY))
    return reshape.append_or_add_row(counts, extra, keys, "n")


@query("melt", S.with_("pivot", select="""
SELECT periodo, setor, 'elogio' AS variable, elogio AS value FROM p
UNION ALL SELECT periodo, setor, 'sugestao', sugestao FROM p
UNION ALL SELECT periodo, setor, 'reclamacao', reclamacao FROM p
UNION ALL SELECT periodo, setor, 'preferiu_nao_informar', preferiu_nao_informar FROM p"""))
def _(spark, d):
    pivot = mf.period_sector_pivot(b.manifestations(spark, d))
    return reshape.melt(pivot, ["periodo", "setor"], list(mf.TYPE_COLUMNS.values()))


@query("dcast", S.with_("manifestations", select="""
SELECT periodo, tipo, count(*) FILTER (WHERE classe = 'detrator') AS detrator,
       count(*) FILTER (WHERE classe = 'neutro') AS neutro,
       count(*) FILTER (WHERE classe = 'promotor') AS promotor FROM m GROUP BY periodo, tipo"""))
def _(spark, d):
    return reshape.dcast(b.manifestations(spark, d), ["periodo", "tipo"], "classe",
                         fv.NPS_CLASSES_V2)


@query("column_totals", S.with_("pivot", select="""
SELECT CAST(sum(elogio) AS BIGINT) AS elogio, CAST(sum(sugestao) AS BIGINT) AS sugestao,
       CAST(sum(reclamacao) AS BIGINT) AS reclamacao, CAST(sum(total) AS BIGINT) AS total FROM p"""))
def _(spark, d):
    pivot = mf.period_sector_pivot(b.manifestations(spark, d))
    return reshape.column_totals(pivot, ["elogio", "sugestao", "reclamacao", "total"])


@query("calendar_dimension", S.with_("general", extra=(S.calendar(1994, 2002),), select="""
SELECT cal.*, coalesce(n, 0) AS n FROM cal LEFT JOIN (
  SELECT ano_consolidacao, mes_consolidacao, count(*) AS n FROM g GROUP BY ALL) t
ON cal."ANO" = t.ano_consolidacao AND cal."MES" = t.mes_consolidacao"""))
def _(spark, d):
    forms = b.general(spark, d).groupBy(*CONSOLIDATION).agg(F.count("*").alias("n"))
    months = cal.calendar_dimension(spark, 1994, 2002)
    on = (months["ANO"] == forms["ano_consolidacao"]) & (months["MES"] == forms["mes_consolidacao"])
    return months.join(forms, on, "left").drop(*CONSOLIDATION).fillna(0, subset=["n"])


@query("equal_width_histogram", """
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
w AS (SELECT o_totalprice AS x, lo, (hi - lo) / 30.0::DOUBLE AS w FROM orders, s),
b AS (SELECT CAST(least(greatest(CAST(ceil((x - lo) / w) AS INTEGER), 1), 30) AS INTEGER) AS bin,
             lo, w FROM w)
SELECT bin, round(lo + (bin - 1) * w, 6) AS lower, round(lo + bin * w, 6) AS upper, count(*) AS n
FROM b GROUP BY ALL""")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    bins = reshape.equal_width_histogram(orders, "o_totalprice", 30)
    return bins.withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


# --- Distinct lists --------------------------------------------------------------------------------


@query("distinct_periods", S.with_("manifestations", select="SELECT DISTINCT periodo FROM m"))
def _(spark, d):
    return periods.distinct_periods(b.manifestations(spark, d))


@query("distinct_sectors", S.with_("manifestations", select=(
    "SELECT DISTINCT periodo, setor FROM m ORDER BY periodo, setor")))
def _(spark, d):
    return periods.distinct_sectors(b.manifestations(spark, d), ["periodo"]).orderBy(
        "periodo", "setor")


@query("period_span", S.with_("general", select="""
SELECT min(ano_consolidacao) AS first_year, max(ano_consolidacao) AS last_year,
       arg_min(mes_ordinal, ano_consolidacao * 12 + mes_ordinal) AS first_month,
       arg_max(mes_ordinal, ano_consolidacao * 12 + mes_ordinal) AS last_month
FROM g WHERE mes_ordinal IS NOT NULL"""))
def _(spark, d):
    return periods.period_span(b.general(spark, d), "ano_consolidacao", "mes_ordinal")


@query("quarter_span", S.with_("nps_rows", extra=(CAL,), select="""
SELECT cal."ID_TRIMESTRE", arg_min(cal."PERIODO_CURTO", cal."MES_ORDINAL") AS first_period,
       arg_max(cal."PERIODO_CURTO", cal."MES_ORDINAL") AS last_period
FROM n JOIN cal ON n."ANO" = cal."ANO" AND n."MES" = cal."MES" GROUP BY 1"""))
def _(spark, d):
    rows = nps.nps_rows(b.general(spark, d), b.ambulatory(spark, d))
    joined = cal.join_calendar(rows, calendar(spark)).where(F.col("ID_TRIMESTRE").isNotNull())
    return periods.quarter_span(joined)
