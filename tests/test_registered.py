"""Every registered query against its SQL, and the shape of its plan."""

import os

import pytest

import __spark_entry__ as entry_points
from fieldtally.plans import catalog

duckdb = pytest.importorskip("duckdb")

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="shared test tables are not here")

SPARK_TO_SQL = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, oracle, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    cursor = oracle.execute(entry_points.oracle_sql()[name])
    columns = {c[0]: str(c[1]) for c in cursor.description}
    assert {c: SPARK_TO_SQL[t] for c, t in df.dtypes} == columns
    wanted = sorted(columns)
    place = [list(columns).index(c) for c in wanted]
    assert ordered(tuple(r) for r in df.select(*wanted).collect()) == ordered(
        tuple(r[i] for i in place) for r in cursor.fetchall()
    )


def test_every_query_has_its_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES) <= set(entry_points.queries())


def test_entry_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["park", "year", "cumsum"]
    assert df.count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = entry_points.queries()["cutoff_and_floor"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_linestatus:string,l_shipdate:timestamp_ntz>" in plan
    assert "LessThan(l_shipdate,2001-01-01" in plan and "GreaterThanOrEqual(l_shipdate,1997-01-01" in plan


def test_taxonomy_join_sees_one_row_per_taxon(spark):
    """The lines are counted before they meet the taxonomy."""
    plan = entry_points.queries()["order_share"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    join, scan = plan.index("Join"), plan.index("l_partkey")
    assert "partial_count(1)" in plan[join:] and scan > join
