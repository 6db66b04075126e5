"""Every registered query against its SQL twin, and the shape of the plans."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from checks.registry import ORACLE, QUERIES
from formpulse import fixed_values as fv

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
DUCKDB_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                "date": "DATE", "timestamp_ntz": "TIMESTAMP"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the benchmark tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    expected = duck.sql(ORACLE[name])
    types = {c: str(t) for c, t in zip(expected.columns, expected.types, strict=True)}
    assert {c: DUCKDB_TYPES[t] for c, t in df.dtypes} == types
    columns = sorted(types)
    order = [expected.columns.index(c) for c in columns]
    want = sorted(repr([row[i] for i in order]) for row in expected.fetchall())
    got = sorted(repr([row[c] for c in columns]) for row in df.collect())
    assert got == want


@pytest.mark.parametrize(("name", "keys", "down"), [
    ("sort_latest_first", ["data"], True), ("sort_period_sector", ["periodo", "setor"], False),
    ("sort_by_rank", ["ano_consolidacao", "mes_consolidacao", "RANK"], False),
])
def test_order(spark, name, keys, down):
    rows = [tuple(r[k] for k in keys) for r in QUERIES[name](spark, str(DATA)).collect()]
    order = [tuple((v is not None, v if v is not None else 0) for v in r) for r in rows]
    assert order == sorted(order, reverse=down) and len(rows) > 1


def test_order_within_groups(spark):
    rows = [(r["periodo"], -r["n"]) for r in QUERIES["sort_by_count"](spark, str(DATA)).collect()]
    assert rows == sorted(rows)
    months = [(r["ano_consolidacao"], fv.MONTHS.index(r["mes_consolidacao"]))
              for r in QUERIES["domain_order"](spark, str(DATA)).collect() if r["mes_consolidacao"]]
    assert months == sorted(months)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLE) <= set(entry_points.oracle_sql())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns[-1] == "proporcao" and df.count() > 0


def plan(spark, name):
    return QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "period_sector_pivot", "nps_summary", "measure_summary", "rating_by_question",
    "rating_distribution", "mean_rating_histogram", "good_or_excellent_indicator",
    "attendant_ratings", "reception_frequency",
    "nps_by_month", "extract_comments_distinct", "daily_counts",
])
def test_report_needs_one_shuffle(spark, name):
    text = plan(spark, name)
    assert len(re.findall(r"\bExchange\b", text)) == 1
    assert "Join" not in text and "Window" not in text


@pytest.mark.parametrize("name", sorted(
    n for n in QUERIES if not re.search("write|read|stream|refresh|load|run|csv|domain_order|sort", n)))
def test_plan_stays_in_the_jvm_and_distributed(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Cartesian" not in text
    assert "BroadcastNestedLoopJoin" not in text
    for window in re.findall(r"Window \[.*", text):
        assert re.search(r"\], \[[a-z]", window), f"window without partition: {window}"


@pytest.mark.parametrize("name", ["sector_share", "share_of_total", "attendant_ranking"])
def test_totals_and_ranks_reuse_the_first_shuffle(spark, name):
    df = QUERIES[name](spark, str(DATA))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_scan_reads_only_what_it_needs(spark):
    text = plan(spark, "nps_summary")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "o_totalprice" not in schema and "o_orderpriority" not in schema
