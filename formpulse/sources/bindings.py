"""Survey forms derived from the benchmark tables, for checks and measurements.

``orders`` becomes raw general, ambulatory and manifestation forms; ``documents`` and
``conversations`` become forms with free-text comments; ``events`` becomes timed manifestations.
Everything is integer arithmetic on the keys, so Spark and the SQL check agree, and every edge
case of the rules occurs: missing and blank answers, unknown months, late consolidation, tied
attendants, names with trailing blanks, missing scores and sectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions.dates import month_name
from formpulse.functions.literals import literal_array
from formpulse.sources.normalize import (
    clean_manifestations,
    normalize_ambulatory,
    normalize_general,
)

ANSWERS = fv.RECEPTION_ANSWERS
SECTORS = ("Ambulatório", "Enfermaria", "Emergência", "UTI", "Farmácia")
MIN_YEAR = 1995


def _text(x: Column) -> Column:
    return x.cast("string")


def answer(i: int) -> Column:
    """Answer ``i`` (1..28) of an order: six texts, sometimes blank, sometimes missing."""
    answers = ", ".join(f"'{a}'" for a in ANSWERS)
    pick = f"(o_orderkey * {i + 2} + o_custkey * {3 * i + 1} + {13 * i}) % 97 % 6"
    return F.expr(
        f"CASE WHEN (o_orderkey + {17 * i}) % 151 = 0 THEN NULL "
        f"WHEN (o_orderkey + {29 * i}) % 149 = 0 THEN '' "
        f"ELSE get(array({answers}), CAST({pick} AS INT)) END"
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _form_columns() -> dict[str, Column]:
    """Columns that all forms share, as text."""
    key, customer, placed = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    late = F.when(key % 37 == 0, F.add_months(placed.cast("date"), -1))
    consolidated = F.coalesce(late, placed.cast("date"))
    month = F.month(consolidated)
    return {
        "data": F.date_format(placed, fv.DISPLAY_TIMESTAMP_PATTERN),
        "nome": F.concat(F.lit("pessoa "), _text(customer)),
        "contato": F.concat(F.lit("c-"), _text(customer)),
        "mes_consolidacao": F.when((month == 3) & (key % 5 == 0), "Marco").otherwise(
            month_name(month)
        ),
        "id": _text(key),
        "ano_consolidacao": _text(F.year(consolidated)),
        "nps": _text(F.nullif(((key * 7 + customer * 3) % 97) % 12, F.lit(11))),
    }


def raw_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General forms in the 46-column text layout: the orders whose key 3 does not divide."""
    key, customer, placed = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    columns = _form_columns() | {q: answer(i) for i, q in enumerate(fv.QUESTIONS, start=1)}
    columns |= {
        "data_internacao": F.date_format(
            F.date_sub(placed.cast("date"), (key % 9).cast("int")), "dd/MM/yyyy"
        ),
        "data_alta": F.when(key % 43 == 0, "xx").otherwise(F.date_format(placed, "dd/MM/yyyy")),
        "autorizo": F.when(key % 2 == 0, "SIM").otherwise("Não"),
        "setor": F.when(key % 23 == 0, "")
        .when(key % 29 == 0, F.lit(None))
        .otherwise(F.get(literal_array(SECTORS), (customer % 5).cast("int"))),
        "elogios": F.when(key % 4 == 0, F.concat(F.lit(" elogio "), _text(customer % 50))),
        "sugestoes": F.when(key % 4 == 1, F.lit(" \t ")).when(
            key % 4 == 2, F.concat(F.lit("sugestão "), _text(customer % 50), F.lit(" "))
        ),
        "reclamacoes": F.when(key % 4 == 3, F.concat(F.lit("reclamação; "), _text(customer % 50))),
        "pesquisa_ativa": F.lit("Sim"),
        "equipe_pesquisa": F.concat(F.lit("equipe "), _text(customer % 3)),
        "quando_queixa": F.lit(None).cast("string"),
        "periodo_queixa": F.lit(None).cast("string"),
    }
    forms = _orders(spark, sf_dir).where(key % 3 != 0)
    return forms.select(*(columns[c].alias(c) for c in fv.LAYOUTS["general46"]))


def raw_ambulatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambulatory forms in the 13-column text layout: the orders whose key 3 divides."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    attendant = F.concat(F.lit("ATT_"), _text(customer % 20))
    columns = _form_columns() | {
        "recepcao": answer(1),
        "medico": answer(2),
        "elogios": F.when(key % 5 == 0, F.concat(F.lit("elogio "), _text(customer % 50))),
        "sugestoes": F.when(key % 5 == 1, F.concat(F.lit("sugestão "), _text(customer % 50))),
        "reclamacoes": F.when(key % 5 == 2, ""),
        "atendente": F.when(key % 19 == 0, "")
        .when(key % 31 == 0, F.lit(None))
        .when(key % 17 == 0, F.concat(attendant, F.lit(" ")))
        .otherwise(attendant),
    }
    forms = _orders(spark, sf_dir).where(key % 3 == 0)
    return forms.select(*(columns[c].alias(c) for c in fv.LAYOUTS["ambulatory13"]))


def raw_manifestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifestations in the 10-column text layout, one per order."""
    key, customer, priority = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    shared = _form_columns()
    columns = {
        "data": shared["data"],
        "setor": F.concat(
            F.lit("  "), F.lower(F.get(literal_array(SECTORS), (customer % 5).cast("int"))),
            F.lit(" "),
        ),
        "nps": shared["nps"],
        "tipo": F.lit("outro"),
        "elogio": F.when(
            priority.isin("3-MEDIUM", "5-LOW"), F.concat(F.lit("elogio "), _text(key))
        ),
        "sugestao": F.when(priority == "2-HIGH", F.concat(F.lit("sugestão "), _text(key))),
        "reclamacao": F.when(
            priority.isin("1-URGENT", "5-LOW"), F.concat(F.lit("reclamação "), _text(key))
        ),
        "nome": F.when(key % 7 != 0, F.concat(F.lit(" maria d'ávila-"), _text(customer % 9),
                                              F.lit("x SOUZA "))),
        "telefone": F.when(key % 11 != 0, F.concat(F.lit("(62) 0000-"), _text(customer))),
        "email": F.when(key % 13 != 0, F.concat(F.lit(" User"), _text(customer),
                                                F.lit("@Example.ORG "))),
    }
    return _orders(spark, sf_dir).select(
        *(columns[c].alias(c) for c in fv.LAYOUTS["manifestation10"])
    )


def raw_comment_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General forms whose comments are the whole document texts, one kind per document."""
    doc = F.col("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.concat(F.lit("pessoa "), _text(doc % 10)).alias("nome"),
        F.concat(F.lit("c-"), _text(doc % 10)).alias("contato"),
        F.when(doc % 2 == 0, "sim").otherwise("não").alias("autorizo"),
        *(F.when(doc % 3 == i, F.col("text")).alias(kind)
          for i, kind in enumerate(fv.COMMENT_KINDS)),
        (2018 + doc % 2).cast("int").alias("ano_consolidacao"),
        month_name((doc % 4 + 1).cast("int")).alias("mes_consolidacao"),
    )


def raw_comment_ambulatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambulatory forms whose comments are the conversation turns; every ninth is blank."""
    conv, turn = F.col("conv_id"), F.col("turn")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.when((conv + turn) % 9 == 0, " \t ").otherwise(F.col("text"))
    return turns.select(
        F.concat(F.lit("pessoa "), _text(conv % 10)).alias("nome"),
        F.concat(F.lit("c-"), _text(conv % 10)).alias("contato"),
        *(F.when(conv % 3 == i, body).alias(kind) for i, kind in enumerate(fv.COMMENT_KINDS)),
        (2018 + conv % 2).cast("int").alias("ano_consolidacao"),
        month_name((conv % 4 + 1).cast("int")).alias("mes_consolidacao"),
    )


def event_manifestations(events: DataFrame) -> DataFrame:
    """Timed manifestations from the event table, batch or stream."""
    kinds = dict(zip(("purchase", "signup", "error"), fv.MANIFESTATION_TYPES[:3], strict=True))
    kind = F.lit(fv.MANIFESTATION_TYPES[3])
    for event_type, name in kinds.items():
        kind = F.when(F.col("event_type") == event_type, name).otherwise(kind)
    return events.select(
        F.col("ts").alias("data"),
        F.concat(F.lit("SETOR "), _text(F.col("user_id") % 8)).alias("setor"),
        kind.alias("tipo"),
    )


def general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_general(raw_general(spark, sf_dir), min_year=None)


def ambulatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_ambulatory(raw_ambulatory(spark, sf_dir))


def manifestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_manifestations(raw_manifestations(spark, sf_dir))
