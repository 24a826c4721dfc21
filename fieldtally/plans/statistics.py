"""Queries: rank-sum test and trend."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.operators import counts, stats
from fieldtally.plans import standin as S
from fieldtally.plans.registry import query

SQL_RANKED = """ranked AS (
    SELECT l_linestatus AS park, l_extendedprice AS v,
           rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS mid_rank
    FROM lineitem)"""


@query(
    f"""
WITH {SQL_RANKED},
sums AS (SELECT count(*) FILTER (park = 'F') AS n1, count(*) FILTER (park = 'O') AS n2, sum(mid_rank) FILTER (park = 'F') AS r1 FROM ranked),
t AS (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_extendedprice))
SELECT n1, n2, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS w, ties FROM sums, t
"""
)
def rank_sum_w(spark, sf):
    lines = S.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("park"), F.col("l_extendedprice").alias("v"))
    return stats.rank_sum(lines, "v", "park", "F", "O")


@query(
    """
WITH pooled AS (SELECT o_orderstatus AS park, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')),
ranked AS (SELECT park, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS mid_rank FROM pooled),
t AS (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM (SELECT count(*) AS c FROM pooled GROUP BY v)),
w AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS w, ties FROM t, (
      SELECT count(*) FILTER (park = 'F') AS n1, count(*) FILTER (park = 'O') AS n2, sum(mid_rank) FILTER (park = 'F') AS r1 FROM ranked)),
z AS (SELECT *, abs(w - n1 * n2 / 2.0::DOUBLE) AS shift,
      sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0::DOUBLE)))) AS sigma FROM w),
x AS (SELECT *, (shift - CASE WHEN shift > 0 THEN 0.5 ELSE 0 END) / sigma / sqrt(2.0::DOUBLE) AS u FROM z)
SELECT n1, n2, w, ties, 'normal' AS method, round(w / (n1::DOUBLE * n2::DOUBLE), 9) AS win_share,
       round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda k: pow(-1, k) * pow(u, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))), 9) AS p_value
FROM x
"""
)
def rank_sum_p(spark, sf):
    orders = S.order_feed(spark, sf).select("park", "positional_accuracy")
    tested = stats.rank_sum_test(orders, "positional_accuracy", "park", "F", "O")
    return tested.withColumns({"p_value": F.round("p_value", 9), "win_share": F.round("win_share", 9)})


@query(f"WITH {SQL_RANKED} SELECT v AS value, count(*) FILTER (park = 'F') AS n1, count(*) FILTER (park = 'O') AS n2, any_value(mid_rank) AS mid_rank FROM ranked GROUP BY v")
def mid_ranks(spark, sf):
    lines = S.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("park"), F.col("l_extendedprice").alias("v"))
    ranked = stats.mid_ranks(stats.value_counts(lines, "v", "park", "F", "O"))
    return ranked.select("value", "n1", "n2", "mid_rank")


def _sql_trend(by: str | None) -> str:
    """Thirty Newton steps over one list of yearly counts per group, by recursion."""
    key, park = ("park, ", "l_linestatus AS park, ") if by else ("", "")
    using = "JOIN lists USING (park)" if by else ", lists"
    of_mid = "JOIN mid USING (park)" if by else ", mid"
    group = "GROUP BY park" if by else ""
    return f"""
WITH RECURSIVE yearly AS (SELECT {park}year(l_shipdate)::DOUBLE AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
mid AS (SELECT {key}avg(y) AS c FROM yearly {group}),
lists AS (SELECT {key}list(y - c ORDER BY y) AS xs, list(n ORDER BY y) AS ns, any_value(c) AS c, ln(avg(n)) AS start FROM yearly {of_mid} {group}),
newton AS (
    SELECT {key}0 AS step, start AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS h11, 0.0::DOUBLE AS h12, 0.0::DOUBLE AS h22, 0.0::DOUBLE AS det FROM lists
    UNION ALL
    SELECT {key}step + 1, a + (h22 * g1 - h12 * g2) / det, b + (h11 * g2 - h12 * g1) / det, h11, h12, h22, det FROM (
        SELECT *, h11 * h22 - h12 * h12 AS det FROM (
            SELECT {key}step, a, b,
                   list_sum(list_transform(range(1, len(xs) + 1), lambda i: ns[i] - exp(a + b * xs[i]))) AS g1,
                   list_sum(list_transform(range(1, len(xs) + 1), lambda i: xs[i] * (ns[i] - exp(a + b * xs[i])))) AS g2,
                   list_sum(list_transform(xs, lambda x: exp(a + b * x))) AS h11,
                   list_sum(list_transform(xs, lambda x: x * exp(a + b * x))) AS h12,
                   list_sum(list_transform(xs, lambda x: x * x * exp(a + b * x))) AS h22
            FROM newton {using} WHERE step < 30))),
fit AS (SELECT {key}a, b, c, h11, h12, h22, det FROM newton {using} WHERE step = 30),
terms AS (
    SELECT {key}'(intercept)' AS term, a - b * c AS estimate, sqrt(h22 / det - 2 * c * (-h12 / det) + c * c * h11 / det) AS std_error FROM fit
    UNION ALL SELECT {key}'year', b, sqrt(h11 / det) FROM fit),
z AS (SELECT *, abs(estimate / std_error) / sqrt(2.0::DOUBLE) AS x FROM terms)
SELECT {key}term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error,
       round(CASE WHEN x < 2
             THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: pow(-1, k) * pow(x, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))))
             ELSE exp(-x * x) / sqrt(pi()) / list_reduce(list_concat([x], list_transform(range(0, 100), lambda k: (100 - k) / 2.0::DOUBLE)), lambda s, k: x + k / s)
             END, 9) AS p_value
FROM z
"""


def _rounded_trend(fit):
    return fit.withColumns({c: F.round(c, n) for c, n in (("estimate", 6), ("std_error", 6), ("p_value", 9))})


@query(_sql_trend(None))
def poisson_trend(spark, sf):
    yearly = counts.count_rows(S.lines(spark, sf).withColumn("year", F.year("obs_date")), "year")
    return _rounded_trend(stats.poisson_trend(yearly))


@query(_sql_trend("park"))
def poisson_trend_by_park(spark, sf):
    """One trend per park, all of them in one pass."""
    yearly = counts.count_rows(S.lines(spark, sf).withColumn("year", F.year("obs_date")), ["park", "year"])
    return _rounded_trend(stats.poisson_trend(yearly, by="park"))


@query(
    """
WITH yearly AS (SELECT o_orderstatus AS park, year(o_orderdate) AS y, count(*) AS n, count(DISTINCT o_custkey) AS v FROM orders
                WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL),
pooled AS (SELECT park, row_number() OVER (ORDER BY v / n::DOUBLE, park, y) AS r FROM yearly),
size AS (SELECT count(*) FILTER (park = 'F') AS n1, count(*) FILTER (park = 'O') AS n2, sum(r) FILTER (park = 'F') AS r1 FROM pooled),
picks AS (SELECT list_sum(list_filter(range(1, n1 + n2 + 1), lambda i: (m >> (i - 1)::BIGINT) & 1 = 1)) AS r
          FROM size, unnest(range(0, (1::BIGINT << (n1 + n2)::BIGINT))) AS t(m) WHERE bit_count(m) = n1)
SELECT n1, n2, CAST(r1 - n1 * (n1 + 1) // 2 AS DOUBLE) AS w, 0.0::DOUBLE AS ties, 'exact' AS method,
       round(CAST(r1 - n1 * (n1 + 1) // 2 AS DOUBLE) / (n1::DOUBLE * n2::DOUBLE), 9) AS win_share,
       round(least(1.0::DOUBLE, 2.0::DOUBLE * least(count(*) FILTER (r <= r1), count(*) FILTER (r >= r1)) / count(*)), 9) AS p_value
FROM size, picks GROUP BY n1, n2, r1
"""
)
def rank_sum_exact(spark, sf):
    """Observers per record and year, between two parks: few values, so the p-value counts all arrangements."""
    dated = S.order_feed(spark, sf).where(F.col("park").isin("F", "O")).withColumn("year", F.year("observed_on"))
    yearly = counts.count_distinct(dated, "user_id", ["park", "year"], "observers", rows_name="n")
    rates = yearly.select("park", (F.col("observers") / F.col("n").cast("double")).alias("rate"))
    tested = stats.rank_sum_test(rates, "rate", "park", "F", "O")
    return tested.withColumns({"p_value": F.round("p_value", 9), "win_share": F.round("win_share", 9)})
