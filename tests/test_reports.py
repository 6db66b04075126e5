"""Reports on small literal frames, against values worked out by hand. All data is invented."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.operators import attendants, calendar, comments, nps, periods, ratings, reshape
from formpulse.operators import manifestations as mf
from formpulse.operators import satisfaction as sat
from formpulse.sources.normalize import clean_manifestations, normalize_general


def ambulatory(spark, data):
    """(attendant, reception ordinal) forms of August 2019."""
    return spark.createDataFrame(
        [(2019, "Agosto", a, r) for a, r in data],
        "ano_consolidacao int, mes_consolidacao string, atendente string, recepcao int")


def test_ranking_gives_ties_their_mean_rank(spark):
    counts = {"ATT_A": 234, "ATT_B": 20, "ATT_C": 20, "ATT_D": 3}
    forms = ambulatory(spark, [(a, 4) for a, n in counts.items() for _ in range(n)])
    got = {r["atendente"]: (r["QTDE_PESQUISADOS"], r["RANK"])
           for r in attendants.attendant_ranking(forms).collect()}
    assert got == {"ATT_A": (234, 1.0), "ATT_B": (20, 2.5), "ATT_C": (20, 2.5), "ATT_D": (3, 4.0)}


def test_attendants_raw_and_trimmed(spark):
    forms = ambulatory(spark, [("ATT_1", 4), ("ATT_1 ", 3), ("", 2), (None, 1), ("ATT_1", None)])
    raw = {r["atendente"] for r in attendants.attendant_ratings(forms).collect()}
    assert raw == {"ATT_1", "ATT_1 ", ""}
    late = forms.withColumn("mes_consolidacao", F.lit("Novembro"))
    (row,) = attendants.attendant_ratings_trimmed(late).collect()
    assert (row["atendente"], row["Otimo"], row["Bom"], row["sem_nota"]) == ("ATT_1", 1, 1, 1)
    assert attendants.attendant_ratings_trimmed(forms).count() == 0


def test_ranks_sum_to_triangle(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 11).alias("n"))
    ranked = reshape.rank_average_ties(df, "n", ["g"])
    sums = ranked.groupBy("g").agg(F.sum("RANK").alias("s"), F.count("*").alias("c")).collect()
    assert all(r["s"] == r["c"] * (r["c"] + 1) / 2 for r in sums)


def test_nps_summary_and_empty_period(spark):
    data = [("a", s) for s in (0, 6, 7, 8, 9, 10, 10, None)] + [("b", None)]
    df = spark.createDataFrame(data, "periodo string, nps int")
    got = {r["periodo"]: r for r in nps.nps_summary(df).collect()}
    assert (got["a"]["detratores"], got["a"]["neutros"], got["a"]["promotores"]) == (2, 2, 3)
    assert (got["a"]["total"], got["a"]["score"], got["a"]["zona"]) == (7, 14.29, "Aperfeiçoamento")
    assert got["a"]["p_promotores"] == "42.86%"
    assert (got["b"]["total"], got["b"]["score"], got["b"]["zona"]) == (0, None, None)
    strict = {r["periodo"]: r for r in nps.nps_summary(df, null_score="detractor").collect()}
    assert (strict["a"]["detratores"], strict["b"]["zona"]) == (3, "Crítica")
    assert nps.nps_summary(df.limit(0)).collect() == []


def test_composition_uses_rounded_percents(spark):
    rows = spark.createDataFrame(
        [(2019, "Julho", "GERAL", i, "Promoter", 1) for i in range(2)]
        + [(2019, "Julho", "GERAL", 9, "Detrator", -1), (2019, "Marco", "GERAL", 10, "Neutro", 0)],
        "ANO int, MES string, ORIGEM string, ID int, CLASSE string, NPS int")
    cal = calendar.calendar_dimension(spark, 2018, 2020)
    (row,) = nps.nps_composition(rows, cal, "2019.Q3").collect()
    assert (row["P_PROMOTORES"], row["P_DETRATORES"], row["NPS"]) == (67.0, 33.0, 34.0)
    joined = calendar.join_calendar(rows, cal)
    assert joined.count() == 4 and joined.where("PERIODO IS NULL").count() == 1
    by_origin = {r["PERIODO_CURTO"]: r["PROP"]
                 for r in nps.nps_by_period_origin(rows, cal).collect()}
    assert by_origin == {"Jul/2019": "33.3%", None: "0%"}


def test_calendar(spark):
    rows = calendar.calendar_dimension(spark, 2018, 2019).orderBy("ANO", "MES_ORDINAL").collect()
    assert len(rows) == 24
    august = rows[19].asDict()
    assert august == {
        "ANO": 2019, "MES": "Agosto", "MES_CURTO": "Ago", "MES_ORDINAL": 8, "SEMESTRE": "2º sim",
        "ID_TRIMESTRE": "2019.Q3", "TRIMESTRE": "3º tri", "BIMESTRE": "4º bim",
        "PERIODO": "2019/Agosto", "PERIODO_CURTO": "Ago/2019"}


def two_forms(spark):
    """General forms with one answered question each, and ambulatory forms, of one period."""
    keys = "ano_consolidacao int, mes_consolidacao string"
    general = spark.createDataFrame(
        [(2019, "Maio", s, r) for s, r in
         [("", 1), (None, 2), ("UTI", 3), ("Ambulatório", 4), ("UTI", None)]],
        f"{keys}, setor string, a_1 int")
    general = general.withColumns(
        {q: F.lit(None).cast("int") for q in fv.QUESTIONS if q != "a_1"})
    amb = spark.createDataFrame(
        [(2019, "Maio", 2, 3), (2019, "Maio", 4, None)], f"{keys}, recepcao int, medico int")
    return general, amb


def test_rating_distribution_parity_and_complete(spark):
    general, amb = two_forms(spark)
    parity = {r["avaliacao"]: (r["freq_x"], r["freq_y"], round(r["fr"], 2))
              for r in ratings.rating_distribution(general, amb).collect()}
    assert parity == {"Regular": (1, 1, 33.33), "Bom": (1, 1, 33.33), "Otimo": (1, 1, 33.33)}
    full = {r["avaliacao"]: (r["freq_x"], r["freq_y"])
            for r in ratings.rating_distribution(general, amb, complete=True).collect()}
    assert full["Ruim"] == (1, 0) and len(full) == 4


def test_buckets_round_means_up(spark):
    general, amb = two_forms(spark)
    got = {(r["form"], r["bucket"]): r["n"]
           for r in ratings.mean_rating_histogram(general, amb).collect()}
    assert got == {("general", 1): 1, ("general", 2): 1, ("general", 3): 1, ("general", 4): 1,
                   ("ambulatory", 3): 1, ("ambulatory", 4): 1}
    indicator = {r["ordinal"]: r["resultado"]
                 for r in ratings.good_or_excellent_indicator(general, amb).collect()}
    assert indicator == {1: 4, 2: 7}


def test_sector_counts(spark):
    general, amb = two_forms(spark)
    got = {r["setor"]: r["qtde"] for r in ratings.sector_form_counts(general, amb).collect()}
    assert got == {"Não informado": 2, "UTI": 2, "Ambulatório": 3}
    alone = ratings.sector_form_counts(general.where("setor = 'UTI'"), amb.limit(0)).collect()
    assert {r["setor"]: r["qtde"] for r in alone} == {"UTI": 2, "Ambulatório": 0}


def raw_general(spark, **answers):
    base = {c: None for c in fv.LAYOUTS["general46"]} | {
        "data": "02/01/2018 10:00:00", "mes_consolidacao": "Dezembro", "ano_consolidacao": "2017",
        "id": "1", "nps": "9", "autorizo": "SIM"}
    schema = ", ".join(f"{c} string" for c in base)
    return spark.createDataFrame([tuple((base | answers).values())], schema)


def test_normalize_general_blocks(spark):
    raw = raw_general(spark, a_1="Bom", a_2="Não se aplica", a_3="Ótimo", b_1="Péssimo", c_1="ruim")
    row = normalize_general(raw).first()
    assert (row["a_1"], row["a_2"], row["a_3"], row["b_1"]) == (3, None, 4, None)
    assert (row["m_a"], row["m_b"], row["m_c"], row["m_x"]) == (3.5, None, 1.0, 2.25)
    assert (row["ano"], row["mes"], row["mes_ordinal"], row["autorizo"]) == (2018, 1, 12, "sim")
    assert normalize_general(raw, min_year=2019).count() == 0


def test_period_rules_differ_around_new_year(spark):
    forms = normalize_general(raw_general(spark))
    assert periods.filter_period(forms, 2017, "Dezembro").count() == 1
    assert periods.filter_period_by_date(forms, 2017, "Dezembro").count() == 0
    assert periods.filter_period_by_date(forms, 2018, "Dezembro").count() == 1


def test_old_layout_gets_missing_columns(spark):
    old = raw_general(spark).select(*fv.LAYOUTS["general41"])
    row = normalize_general(old).first()
    assert row["nps"] is None and row["pesquisa_ativa"] is None


def test_composite_and_strict_nulls(spark):
    asked = [q for q in fv.COMPOSITE_QUESTIONS if q]
    full = raw_general(spark, **dict.fromkeys(asked, "Bom") | {asked[0]: "Não se aplica"})
    gap = raw_general(spark, **dict.fromkeys(asked[1:], "Bom"))
    composite = sat.composite_satisfaction(full.union(gap))
    first, second = composite.orderBy(F.col("SATISFACAO").isNull()).collect()
    assert (first["QTD_RESP"], first["SATISFACAO"], first["S09"], first["S"]) == (
        11, 0.8, 0.0, "BOM/OTIMO")
    assert second["SATISFACAO"] is None and second["S"] is None
    (loose,) = sat.satisfaction_by_period(composite).collect()
    assert (loose["PERIODO"], loose["QTDE"], loose["MEDIA"], loose["MEDIANA"]) == (
        dt.date(2017, 12, 1), 2, 0.8, 0.8)
    (strict,) = sat.satisfaction_by_period(composite, strict_nulls=True).collect()
    assert strict["MEDIA"] is None and strict["QTDE"] == 2


def test_measure_summary(spark):
    keys = "ano_consolidacao int, mes_consolidacao string"
    means = ", ".join(f"m_{b} double" for b in fv.BLOCK_SIZES)
    general = spark.createDataFrame(
        [(2019, "Maio", 4.0, 2.0, None, None, None, None, None, None),
         (2019, "Maio", 3.0, None, None, None, None, None, None, None)], f"{keys}, {means}")
    amb = spark.createDataFrame([(2019, "Maio", 4.0), (2019, "Junho", 1.0)], f"{keys}, m double")
    got = {(r["mes_consolidacao"], r["medida"]): r["percentual"]
           for r in sat.measure_summary(general, amb).collect()}
    assert len(got) == 20
    assert got["Maio", "Recepção"] == 87.5 and got["Maio", "Médico"] == 50.0
    assert got["Maio", "Enfermagem"] is None and got["Maio", "Ambulatório"] == 100.0
    assert round(got["Maio", "Geral"], 6) == round((87.5 + 50 + 100) / 3, 6)
    assert got["Junho", "Geral"] == 25.0


def test_comments_bag_and_distinct(spark):
    schema = ("ano_consolidacao int, mes_consolidacao string, autorizo string, nome string, "
              "contato string, elogios string, sugestoes string, reclamacoes string")
    general = spark.createDataFrame(
        [(2019, "Maio", "sim", "pessoa 1", "c-1", "ok ", None, " \t "),
         (2019, "Maio", "não", "pessoa 2", "c-2", "ok", "", "ruim; \"muito\"\nmesmo")], schema)
    amb = general.drop("autorizo").limit(1)
    bag = comments.extract_comments(general, amb).collect()
    assert sorted((r["kind"], r["texto"]) for r in bag) == [
        ("elogios", "ok"), ("elogios", "ok "), ("elogios", "ok "),
        ("reclamacoes", "ruim; \"muito\"\nmesmo")]
    assert sum(r["autorizo"] == "Sim" for r in bag) == 1
    once = comments.extract_comments_distinct(general, amb).collect()
    assert sorted(r["texto"] for r in once) == ["ok", "ruim; \"muito\"\nmesmo"]


def manifestations(spark):
    def row(day, sector, score, e=None, s=None, r=None):
        return (f"{day} 10:00:00", sector, score, "x", e, s, r, " ana-lia ", "(0) 1", None)

    raw = spark.createDataFrame(
        [row("1/5/2024", " uti ", "9", e="a", r="b"), row("2/5/2024", "UTI", None, s="c"),
         row("2/5/2024", "lab", "6"), row("1/6/2024", "lab", "7", r="d")],
        ", ".join(f"{c} string" for c in fv.LAYOUTS["manifestation10"]))
    return clean_manifestations(raw)


def test_clean_manifestations(spark):
    df = manifestations(spark)
    assert tuple(df.columns) == fv.CLEAN_COLUMNS
    first = df.where("tipo = 'elogio'").first()
    assert (first["periodo"], first["setor"], first["nome"], first["telefone"], first["email"]) == (
        "2024/05", "UTI", "Ana-Lia", "01", "-")
    missing = df.where("nps IS NULL").first()
    assert (missing["classe"], missing["flag"]) == ("detrator", "🔴")


def test_pivot_and_shares(spark):
    stats = mf.sector_share(mf.period_sector_pivot(manifestations(spark)))
    got = {(r["periodo"], r["setor"]): r for r in stats.collect()}
    uti = got["2024/05", "UTI"]
    assert (uti["elogio"], uti["sugestao"], uti["reclamacao"], uti["total"], uti["n_periodo"]) == (
        1, 1, 0, 2, 3)
    assert uti["proporcao"] == 0.6667 and got["2024/06", "LAB"]["proporcao"] == 1.0
    shown = mf.rename_display(stats)
    assert {"elogios", "não informou", "% proporção"} <= set(shown.columns)


def test_missing_group_keys_keep_their_totals(spark):
    df = spark.createDataFrame([(None, "x", 1), (None, "y", 3), ("p", "x", 5)],
                               "periodo string, setor string, total int")
    got = {(r["periodo"], r["setor"]): r["proporcao"] for r in mf.sector_share(df).collect()}
    assert got == {(None, "x"): 0.25, (None, "y"): 0.75, ("p", "x"): 1.0}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.1, 2.0, 4.0, None, float("nan"))], "x double")
    got = {r["bin"]: (r["lower"], r["upper"], r["n"])
           for r in reshape.equal_width_histogram(df, "x", 4).collect()}
    assert got == {1: (0.0, 1.0, 2), 2: (1.0, 2.0, 2), 4: (3.0, 4.0, 1)}
    constant = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r["n"] for r in reshape.equal_width_histogram(constant, "x", 3).collect()] == [2]


@pytest.mark.parametrize(("year", "month"), [(2016, "Maio"), (2026, "Maio"), (2019, "Marco")])
def test_period_arguments(year, month):
    with pytest.raises(ValueError, match="must be"):
        periods.validate_period_args(year, month, (2017, 2025))
    if month in fv.MONTHS:
        assert periods.validate_period_args(year, month) == (year, month)


def test_reports_take_a_site_key(spark):
    sited = manifestations(spark).withColumn("site", F.lit("A"))
    both = sited.unionByName(sited.withColumn("site", F.lit("B")))
    stats = mf.sector_share(mf.period_sector_pivot(both, ["site", "periodo"]), ["site", "periodo"])
    assert stats.count() == 6 and stats.where("n_periodo = 3").count() == 4
    assert nps.nps_summary(both, ["site", "periodo"]).count() == 4
