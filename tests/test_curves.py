"""First records and cumulative series."""

import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import curves
from fieldtally.sources import inline_rows

D = dt.date


@pytest.fixture(scope="module")
def sightings(spark):
    table = [
        ("a", "u1", "2001-05-01", 3),
        ("a", "u1", "2001-05-01", 1),
        ("a", "u1", "1999-01-01", 9),
        ("a", "u2", "2001-02-01", 4),
        ("a", "u3", None, 5),
        ("b", "u1", "2003-03-03", 6),
        ("b", "u4", "2003-03-03", 7),
        ("b", "u4", None, 8),
        ("b", None, "2004-01-01", 2),
    ]
    df = inline_rows(spark, ["park", "user", "d", "line"], table)
    return df.withColumn("d", F.col("d").cast("date")).cache()


def test_first_date_ignores_missing_dates(sightings, rows):
    found = curves.first_date(sightings, ["park", "user"], "d")
    assert rows(found) == [
        ("a", "u1", D(1999, 1, 1)),
        ("a", "u2", D(2001, 2, 1)),
        ("b", None, D(2004, 1, 1)),
        ("b", "u1", D(2003, 3, 3)),
        ("b", "u4", D(2003, 3, 3)),
    ]


def test_strict_first_date_drops_a_key_with_a_gap(sightings, rows):
    strict = curves.first_date(sightings, ["park", "user"], "d", strict=True)
    assert [r[:2] for r in rows(strict)] == [("a", "u1"), ("a", "u2"), ("b", None), ("b", "u1")]


def test_first_row_breaks_ties(sightings, rows):
    later = sightings.where("line <> 9")
    found = curves.first_row(later, ["park", "user"], ["d", "line"])
    assert rows(found, "park", "user", "line") == [("a", "u1", 1), ("a", "u2", 4), ("b", None, 2), ("b", "u1", 6), ("b", "u4", 7)]
    strict = curves.first_row(later, ["park", "user"], ["d", "line"], strict=True)
    assert rows(strict, "park", "user", "line") == [("a", "u1", 1), ("a", "u2", 4), ("b", None, 2), ("b", "u1", 6)]
    assert found.columns == later.columns


def test_accumulation_per_park(sightings, rows):
    curve = curves.accumulation(sightings, "user", "d", "park", new_name="new")
    assert rows(curve) == [("a", 1999, 1, 1), ("a", 2001, 1, 2), ("b", 2003, 2, 2), ("b", 2004, 1, 3)]


def test_curves_never_fall(spark):
    df = spark.range(3000).select(
        F.pmod(F.hash("id"), F.lit(40)).alias("user"),
        F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(F.hash(F.col("id") + 7), F.lit(9000))).alias("d"),
    )
    for curve in (curves.accumulation(df, "user", "d"), curves.records_curve(df, "d")):
        values = [r["cumsum"] for r in curve.orderBy("year").collect()]
        assert values == sorted(values)
    assert curves.accumulation(df, "user", "d").agg(F.max("cumsum")).first()[0] == 40
    assert curves.records_curve(df, "d").agg(F.max("cumsum")).first()[0] == 3000


def test_forward_fill_and_last_point(spark, rows):
    curve = inline_rows(spark, ["park", "year", "cumsum"], [("a", 2000, 1), ("a", 2003, 4), ("b", 2001, 7), ("b", 2006, 9)])
    filled = curves.filled_to_year(curve, "park", 2004)
    assert rows(filled) == [
        ("a", 2000, 1),
        ("a", 2001, 1),
        ("a", 2002, 1),
        ("a", 2003, 4),
        ("a", 2004, 4),
        *[("b", y, 7) for y in range(2001, 2006)],
        ("b", 2006, 9),
    ]
    assert rows(curves.last_point(curve, "park"), "park", "year", "cumsum") == [("a", 2003, 4), ("b", 2006, 9)]


def test_combined_curves_keep_missing_sums(spark, rows):
    a = inline_rows(spark, ["year", "cumsum"], [(2000, 1), (2001, 2)])
    b = inline_rows(spark, ["year", "cumsum"], [(2001, 5), (2002, 6)])
    assert rows(curves.combined_curves(a, b), "year", "cumsum") == [(2000, None), (2001, 7)]


def test_yearly_totals_start_at_zero(spark, rows):
    df = spark.sql(
        "SELECT * FROM VALUES (date'1958-01-01', 's1', 'u1'), (date'1962-01-01', 's1', 'u2'), "
        "(date'1962-05-01', NULL, 'u2'), (date'1963-01-01', 's2', 'u1') AS t(d, s, u)"
    )
    out = curves.yearly_totals(df, "d", "s", "u", 1960, 1964)
    assert rows(out) == [(1960, 1, 1, 1), (1961, 1, 1, 1), (1962, 3, 1, 2), (1963, 4, 2, 2), (1964, 4, 2, 2)]
    assert rows(curves.yearly_totals(df.where("d > '1961-01-01'"), "d", "s", "u", 1960, 1961)) == [(1960, 0, 0, 0), (1961, 0, 0, 0)]


def test_one_per_key(spark, rows):
    df = inline_rows(spark, ["k", "a", "b"], [("x", 2, "p"), ("x", 1, "r"), ("x", 1, "q"), ("y", 5, "z")])
    assert rows(curves.one_per_key(df, "k", ["a"])) == [("x", 1, "q"), ("y", 5, "z")]


def test_first_rows_are_found_late(spark):
    """Whole rows are compared only where the first date is shared; over all rows key and date are aggregated."""
    rng = random.Random(2)
    table = [(rng.choice(["a", "b", None, "c"]), rng.choice([None, "2020-01-01", "2020-01-02", "2020-01-02"]), rng.randint(0, 9), "x" * rng.randint(0, 3)) for _ in range(300)]
    df = spark.createDataFrame(table, "k string, d string, n int, `t.x` string").withColumn("d", F.col("d").cast("date"))
    rank = lambda r: (r[1], r[2], r[3])
    wanted = [min((r for r in table if r[0] == k and r[1]), key=rank) for k in ("a", "b", None, "c")]
    found = curves.first_row(df, "k", ["d", "n"])
    assert sorted(((r[0], str(r[1]), r[2], r[3]) for r in found.collect()), key=str) == sorted(wanted, key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("min_by") < plan.index("LeftSemi") < plan.index("min(d")
    assert curves.first_row(df, "k", ["d", "n"], strict=True).count() == 0
    least = curves.one_per_key(df, "k", ["n", "d"])
    none_first = lambda r: (r[2], r[1] is not None, r[1] or "", r[3])
    wanted = [min((r for r in table if r[0] == k), key=none_first) for k in ("a", "b", None, "c")]
    assert sorted(((r[0], r[1] and str(r[1]), r[2], r[3]) for r in least.collect()), key=str) == sorted(wanted, key=str)
