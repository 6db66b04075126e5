"""Each rule on the edge cases that a form can hold. All people and texts are invented."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from formpulse import functions as fn
from formpulse.functions.numbers import half_even


def values(spark, column, data, kind="string"):
    df = spark.createDataFrame([(v,) for v in data], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_likert_ordinal(spark):
    given = ["Ruim", "REGULAR", "bom", "Ótimo", "otimo", "ÓTIMO", "Não se aplica", "nao se aplica",
             "Péssimo", "", None, "talvez"]
    assert values(spark, lambda _: fn.likert_ordinal("x"), given) == [1, 2, 3, 4, 4, 4] + [None] * 6


def test_likert_score(spark):
    given = ["Péssimo", "Ruim", "Regular", "Bom", "Ótimo", "Não se aplica", "", "bom", None]
    assert values(spark, lambda _: fn.likert_score("x"), given) == [0.2, 0.4, 0.6, 0.8, 1.0, 0, 0, 0, None]


def test_rating_label(spark):
    assert values(spark, fn.rating_label, [1, 4, 0, 5, None], "int") == [
        "Ruim", "Otimo", None, None, None]
    assert values(spark, lambda x: fn.rating_label(x, "Nda"), [2, 9, None], "int") == [
        "Regular", "Nda", "Nda"]


def test_row_mean_skips_missing(spark):
    df = spark.createDataFrame([(1, 2, None), (None, None, None), (4, 4, 1)], "a int, b int, c int")
    assert [r[0] for r in df.select(fn.row_mean(["a", "b", "c"])).collect()] == [1.5, None, 3.0]


@pytest.mark.parametrize(("style", "policy", "expected"), [
    ("v1", "drop", ["Detrator", "Detrator", "Neutro", "Neutro", "Promoter", "Promoter", None]),
    ("v2", "detractor",
     ["detrator", "detrator", "neutro", "neutro", "promotor", "promotor", "detrator"]),
    ("v2", "neutral",
     ["detrator", "detrator", "neutro", "neutro", "promotor", "promotor", "neutro"]),
])
def test_nps_class(spark, style, policy, expected):
    given = [0, 6, 7, 8, 9, 10, None]
    got = values(spark, lambda x: fn.nps_class(x, style=style, null_score=policy), given, "int")
    assert got == expected


def test_nps_class_rejects_unknown_policy(spark):
    with pytest.raises(ValueError, match="null_score"):
        fn.nps_class(F.col("x"), null_score="maybe")


def test_nps_zone_edges(spark):
    given = [-1.0, 0.0, 49.99, 50.0, 74.99, 75.0, 75.01, None]
    v1 = values(spark, lambda x: fn.nps_zone(x, policy="v1"), given, "double")
    v2 = values(spark, lambda x: fn.nps_zone(x, policy="v2"), given, "double")
    critical, improve, quality, best = (
        "ZONA CRÍTICA", "ZONA DE APERFEIÇOAMENTO", "ZONA DE QUALIDADE", "ZONA DE EXCELENCIA")
    assert v1 == [critical, critical, improve, improve, quality, quality, best, None]
    assert v2 == ["Crítica", "Aperfeiçoamento", "Aperfeiçoamento", "Qualidade", "Qualidade",
                  "Excelência", "Excelência", None]


def test_timestamps_and_dates(spark):
    given = ["1/2/2023 8:05:09", "01/02/2023 08:05:09", "xx", "31/02/2023 00:00:00", None]
    moment = dt.datetime(2023, 2, 1, 8, 5, 9)
    assert values(spark, fn.parse_survey_timestamp, given) == [moment, moment, None, None, None]
    assert values(spark, fn.parse_survey_date, ["1/2/2023", "x", None]) == [
        dt.date(2023, 2, 1), None, None]


def test_months(spark):
    assert values(spark, fn.month_ordinal, ["Janeiro", "Março", "Marco", "", None]) == [
        1, 3, None, None, None]
    assert values(spark, fn.month_name, [1, 12, 13, None], "int") == [
        "Janeiro", "Dezembro", None, None]
    first = spark.sql("SELECT 2019 AS a, 'Janeiro' AS m UNION ALL SELECT 2019, 'x'").select(
        fn.period_from_parts(F.col("a"), F.col("m")).alias("p"))
    got = {tuple(r) for r in first.select("p", fn.period_label(F.col("p"))).collect()}
    assert got == {(dt.date(2019, 1, 1), "Jan/2019"), (None, None)}


def test_text_rules(spark):
    assert values(spark, fn.trim_ws, [" \t a b\n", " \t ", None]) == ["a b", "", None]
    assert values(spark, fn.normalize_sector, ["  clínica a ", None]) == ["CLÍNICA A", None]
    names = [" maria d'ávila-souza ", "JOÃO 2b", "o’neil", None]
    assert values(spark, fn.normalize_name, names) == [
        " maria d'ávila-souza ".strip().title(), "JOÃO 2b".title(), "o’neil".title(), None]
    assert values(spark, fn.normalize_email, [" A@B.Org "]) == ["a@b.org"]
    assert values(spark, fn.normalize_phone, ["(00) 0000-0000", "x", None]) == [
        "0000000000", "", None]
    assert values(spark, fn.cast_id, ["17", "n/d", None]) == [17, None, None]
    assert values(spark, fn.has_comment, ["ok", " \t ", "", None]) == [True, False, False, False]


def test_manifestation_precedence(spark):
    df = spark.createDataFrame(
        [("e", "s", "r"), (None, "s", "r"), (None, None, "r"), (None, None, None)],
        "e string, s string, r string")
    cols = [F.col(c) for c in "esr"]
    got = df.select(fn.manifestation_type(*cols), fn.manifestation_text(*cols)).collect()
    assert [tuple(r) for r in got] == [
        ("elogio", "e"), ("sugestao", "s"), ("reclamacao", "r"), ("preferiu nao informar", "-")]


def test_half_even_is_numpy_rounding(spark):
    import numpy as np

    data = [k / n * s for n in range(1, 60) for k in range(-n, n + 1) for s in (1, 100)]
    for digits in (0, 1, 2, 4):
        got = values(spark, lambda x, d=digits: half_even(x, d), data, "double")
        assert got == [float(v) for v in np.round(np.array(data), digits) + 0.0]


def test_percent_label(spark):
    given = [100.0, 66.666, 33.35, 0.0, -0.01, 12.5, None]
    assert values(spark, lambda x: fn.percent_label(x, 1), given, "double") == [
        "100%", "66.7%", "33.4%", "0%", "0%", "12.5%", None]
    assert values(spark, lambda x: fn.percent_label(x, 2, fixed=True), given[:2], "double") == [
        "100.00%", "66.67%"]


def test_satisfaction_band(spark):
    assert values(spark, fn.satisfaction_band, [0.8, 0.0, 0.79, None], "double") == [
        "BOM/OTIMO", "NULO", "BAIXO", None]


def test_exact_mean_does_not_depend_on_partitions(spark):
    df = spark.range(20_000).select((F.col("id") % 29 / 7.0).alias("x"))
    got = {
        df.repartition(n).agg(fn.exact_mean(F.col("x"), 420).alias("m")).first()["m"]
        for n in (1, 3, 7)
    }
    assert len(got) == 1
