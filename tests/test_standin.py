"""How the lines and headers of the test tables are dealt and reduced before they meet."""

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import counts, predicates as P
from fieldtally.plans import standin as S
from fieldtally.plans.basics import PROTOCOL_WORDS


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A third of the lines in one checklist, some without a key or a duration; some headers twice, some without a key."""
    folder = str(tmp_path_factory.mktemp("tables"))
    orders = """SELECT CASE WHEN id % 211 = 5 THEN NULL ELSE id % 2900 END AS o_orderkey, id % 70 AS o_custkey, element_at(array('F', 'O', 'P'), cast(id % 3 AS int) + 1) AS o_orderstatus,
                element_at(array('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'), cast(id % 4 AS int) + 1) AS o_orderpriority,
                timestamp_ntz'1997-01-01 00:00:00' + make_dt_interval(cast(id % 900 AS int)) AS o_orderdate, id * 1D AS o_totalprice FROM range(3000)"""
    lines = """SELECT CASE WHEN id % 3 = 0 THEN 7 WHEN id % 101 = 1 THEN NULL ELSE id % 2900 END AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber,
               CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN double('NaN') ELSE (id * 7) % 50 * 0.5D END AS l_quantity, 1D AS l_extendedprice, 'R' AS l_returnflag,
               element_at(array('F', 'O', NULL), cast(id % 5 % 3 AS int) + 1) AS l_linestatus,
               timestamp_ntz'1997-01-01 00:00:00' + make_dt_interval(cast(id % 97 AS int)) AS l_shipdate FROM range(20000)"""
    spark.sql(orders).write.parquet(f"{folder}/orders.parquet")
    spark.sql(lines).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_join_is_dealt_by_the_number_of_rows(spark, tables, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_TASK", 500, raising=False)
    joined = S.reduced_lines_with_headers(spark, tables, "park")
    dealt = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(dealt) > 40 and max(dealt) < 500


def test_durations_on_one_side_of_the_threshold_travel_together(spark, tables):
    hot = S.reduced_lines_with_headers(spark, tables, "park").where("checklist_id = 7").groupBy("park", "observer_id").count()
    assert {r["count"] for r in hot.collect()} <= {1, 2, 3}


@pytest.mark.parametrize("rows_per_task", [500, 250_000])
def test_summaries_of_reduced_lines_are_those_of_all_lines(spark, rows, tables, monkeypatch, rows_per_task):
    monkeypatch.setattr(S, "ROWS_PER_TASK", rows_per_task, raising=False)
    whole = S.lines(spark, tables).join(S.headers(spark, tables), "checklist_id")
    for rule in ("standard", "protocol", "richness"):
        complete = P.is_complete(rule=rule, **PROTOCOL_WORDS)
        reduced = S.reduced_lines_with_headers(spark, tables, "park")
        got = counts.completeness_summary(reduced, "checklist_id", "observer_id", complete, "park", weight="k")
        assert rows(got) == rows(counts.completeness_summary(whole, "checklist_id", "observer_id", complete, "park"))
    by_month = S.reduced_lines_with_headers(spark, tables, "park", F.trunc("obs_date", "month").alias("month"))
    series = [
        counts.monthly_variants(df, date, P.is_complete(**PROTOCOL_WORDS), ("all", "complete"), by="park", distinct="checklist_id")
        for df, date in ((by_month, "month"), (whole, "obs_date"))
    ]
    assert rows(series[0]) == rows(series[1]) != []
