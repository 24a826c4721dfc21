"""Queries: monthly series, first records, accumulation curves, participation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.functions.dates import month_from_parts, month_of, month_start, year_of
from fieldtally.operators import calendar as K
from fieldtally.operators import counts, curves, participation, predicates as P, reshape
from fieldtally.plans import standin as S
from fieldtally.plans.basics import PROTOCOL_WORDS, SQL_COMPLETE
from fieldtally.plans.registry import query

SQL_MONTHLY = f"""{S.SQL_LINES}, monthly AS (
    SELECT park, CAST(date_trunc('month', obs_date) AS DATE) AS date, count(DISTINCT checklist_id) AS tot_obs
    FROM lines GROUP BY ALL)"""
SQL_FILLED = f"""{SQL_MONTHLY}, filled AS (
    SELECT park, date, coalesce(tot_obs, 0) AS tot_obs
    FROM (SELECT park, CAST(d AS DATE) AS date FROM (SELECT DISTINCT park FROM monthly),
          generate_series(TIMESTAMP '1993-01-01', TIMESTAMP '2003-12-01', INTERVAL 1 MONTH) AS g(d))
    FULL JOIN monthly USING (park, date))"""


def _monthly(spark, sf):
    return counts.monthly_counts(S.lines(spark, sf), "obs_date", "park", "checklist_id")


def _filled(spark, sf):
    return K.zero_filled(_monthly(spark, sf), by="park", first="1993-01-01", last="2003-12-01")


@query(
    f"""
WITH {S.SQL_LINES}, {S.SQL_HEADERS}, chk AS (
    SELECT *, CAST(date_trunc('month', obs_date) AS DATE) AS date FROM lines JOIN headers USING (checklist_id))
SELECT park, date, count(DISTINCT checklist_id) AS tot_obs, 'Total checklists' AS data FROM chk GROUP BY park, date
UNION ALL
SELECT park, date, count(DISTINCT checklist_id), 'Complete checklists' FROM chk WHERE {SQL_COMPLETE} GROUP BY park, date
"""
)
def monthly_checklists(spark, sf):
    # grouping by month shrinks the lines before the join
    return counts.monthly_variants(
        S.reduced_lines_with_headers(spark, sf, "park", month_start("obs_date").alias("month")),
        "month",
        P.is_complete(**PROTOCOL_WORDS),
        ("Total checklists", "Complete checklists"),
        by="park",
        distinct="checklist_id",
    )


@query(
    f"""
WITH {S.SQL_LINES}, dated AS (SELECT *, CAST(date_trunc('month', obs_date) AS DATE) AS date FROM lines)
SELECT date, count(*) AS tot_obs, 'Total observations' AS data FROM dated GROUP BY date
UNION ALL
SELECT date, count(*), 'Research grade observations' FROM dated WHERE quality_grade = 'research' GROUP BY date
"""
)
def monthly_records_by_grade(spark, sf):
    return counts.monthly_variants(
        S.lines(spark, sf), "obs_date", P.is_research(), ("Total observations", "Research grade observations")
    )


@query(
    """
SELECT make_date(y, m, 1) AS month, y AS year, m AS month_number, count(*) AS n FROM (
    SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders) GROUP BY ALL
"""
)
def month_keys(spark, sf):
    parts = S.order_feed(spark, sf).select(year_of("observed_on").alias("year"), month_of("observed_on").alias("month_number"))
    return counts.count_rows(parts.withColumn("month", month_from_parts("year", "month_number")), ["month", "year", "month_number"])


@query(f"WITH {SQL_FILLED} SELECT * FROM filled")
def zero_filled_months(spark, sf):
    return _filled(spark, sf)


_MEAN_SE = """count(*) AS n, CAST(sum(tot_obs) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean,
       CASE WHEN count(*) > 1 THEN
       sqrt(CAST(count(*) * sum(CAST(tot_obs AS HUGEINT) * tot_obs) - sum(tot_obs) * sum(tot_obs) AS DOUBLE)
            / CAST(count(*) * (count(*) - 1) AS DOUBLE)) / sqrt(CAST(count(*) AS DOUBLE)) END AS se"""


@query(
    f"""
WITH {SQL_FILLED}
SELECT park, 'early' AS period, {_MEAN_SE} FROM filled WHERE date BETWEEN DATE '1993-01-01' AND DATE '1997-06-01' GROUP BY park
UNION ALL
SELECT park, 'current', {_MEAN_SE} FROM filled WHERE date >= DATE '1997-06-01' GROUP BY park
UNION ALL
SELECT park, 'one month', {_MEAN_SE} FROM filled WHERE date = DATE '1998-03-01' GROUP BY park
"""
)
def period_mean_se(spark, sf):
    periods = {
        "early": ("1993-01-01", "1997-06-01"),
        "current": ("1997-06-01", None),
        "one month": ("1998-03-01", "1998-03-01"),
    }
    return K.period_mean_se(_filled(spark, sf), periods, by="park")


@query(
    f"""
WITH {SQL_FILLED}
SELECT park, 'summer' AS period, {_MEAN_SE} FROM filled
WHERE date BETWEEN DATE '1996-06-01' AND DATE '2001-08-31' AND month(date) IN (6, 7, 8) GROUP BY park
UNION ALL
SELECT park, 'winter', {_MEAN_SE} FROM filled
WHERE date BETWEEN DATE '1995-12-01' AND DATE '2001-02-28' AND month(date) IN (12, 1, 2) GROUP BY park
"""
)
def season_mean_se(spark, sf):
    return K.period_mean_se(
        _filled(spark, sf),
        {"summer": ("1996-06-01", "2001-08-31"), "winter": ("1995-12-01", "2001-02-28")},
        by="park",
        months={"summer": (6, 7, 8), "winter": (12, 1, 2)},
    )


@query(
    f"""
WITH {S.SQL_LINES}, {S.SQL_HEADERS}, richness AS (
    SELECT checklist_id, count(*) AS tot_obs FROM lines JOIN headers USING (checklist_id)
    WHERE category = 'species' AND {SQL_COMPLETE} GROUP BY checklist_id)
SELECT {_MEAN_SE} FROM richness
"""
)
def richness_per_checklist(spark, sf):
    reduced = S.reduced_lines_with_headers(spark, sf, "category")
    complete = reduced.where(P.is_species() & P.is_complete(**PROTOCOL_WORDS))
    return K.mean_se(counts.count_rows(complete, "checklist_id", "richness", "k"), "richness")


def _first_dates(spark, sf):
    """First date per park and checklist with the checklist's observer: the lines stop here."""
    per_list = curves.first_date(S.lines(spark, sf), ["park", "checklist_id"], "obs_date")
    return per_list.join(S.headers(spark, sf).select("checklist_id", "observer_id"), "checklist_id")


@query(
    f"""
WITH {S.SQL_LINES}, {S.SQL_HEADERS}
SELECT park, observer_id, min(obs_date) AS obs_date FROM lines JOIN headers USING (checklist_id) GROUP BY park, observer_id
"""
)
def first_record_date(spark, sf):
    return curves.first_date(_first_dates(spark, sf), ["park", "observer_id"], "obs_date")


@query(
    """
SELECT part_id, min(d) AS obs_date FROM (
    SELECT l_partkey AS part_id, CASE WHEN l_linenumber < 7 OR l_quantity <= 40 THEN CAST(l_shipdate AS DATE) END AS d FROM lineitem)
GROUP BY part_id HAVING count(*) = count(d)
"""
)
def first_record_strict(spark, sf):
    """First dates where every date of the taxon is known."""
    known = (F.col("line") < 7) | (F.col("duration_min") <= 40)
    dated = S.lines(spark, sf).withColumn("obs_date", F.when(known, F.col("obs_date")))
    return curves.first_date(dated, "part_id", "obs_date", strict=True)


_FIRST_COLUMNS = ["observer_id", "obs_date", "checklist_id", "line", "part_id", "site_id", "duration_min", "longitude"]


@query(
    f"""
WITH {S.SQL_LINES}, {S.SQL_HEADERS}
SELECT {", ".join(_FIRST_COLUMNS)} FROM lines JOIN headers USING (checklist_id)
QUALIFY row_number() OVER (PARTITION BY observer_id ORDER BY {", ".join(_FIRST_COLUMNS[1:])}) = 1
"""
)
def first_record_row(spark, sf):
    # the first line of every checklist, then the first of those of every observer
    own = [c for c in _FIRST_COLUMNS if c != "observer_id"]
    per_list = curves.first_row(S.lines(spark, sf).select(*own), "checklist_id", ["obs_date", "line"])
    observers = S.headers(spark, sf).select("checklist_id", "observer_id")
    feed = per_list.join(observers, "checklist_id").select(*_FIRST_COLUMNS)
    return curves.first_row(feed, "observer_id", ["obs_date", "checklist_id", "line"])


@query(
    """
SELECT p_name AS scientific_name, p_brand AS family, p_type AS "order", p_partkey AS part_id FROM part
QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_type, p_partkey) = 1
"""
)
def one_row_per_name(spark, sf):
    entries = S.taxa(spark, sf).select("scientific_name", "family", "order", "part_id")
    return curves.one_per_key(entries, "scientific_name", ["family", "order"])


SQL_OBSERVER_CURVE = f"""{S.SQL_LINES}, {S.SQL_HEADERS}, firsts AS (
    SELECT park, observer_id, year(min(obs_date)) AS year FROM lines JOIN headers USING (checklist_id) GROUP BY park, observer_id),
fresh AS (SELECT park, year, count(*) AS n FROM firsts GROUP BY park, year),
observer_curve AS (SELECT park, CAST(year AS INTEGER) AS year,
    CAST(sum(n) OVER (PARTITION BY park ORDER BY year) AS BIGINT) AS cumsum FROM fresh)"""


@query(f"WITH {SQL_OBSERVER_CURVE} SELECT * FROM observer_curve")
def observer_curve(spark, sf):
    return curves.accumulation(_first_dates(spark, sf), "observer_id", "obs_date", "park")


@query(
    f"""
WITH {S.SQL_LINES}, {S.SQL_TAXA}, firsts AS (
    SELECT park, scientific_name, family, year(min(obs_date)) AS year FROM lines JOIN taxa USING (part_id)
    WHERE quality_grade = 'research' GROUP BY ALL),
fresh AS (SELECT park, year, count(*) AS tot_obs FROM firsts GROUP BY park, year)
SELECT park, CAST(year AS INTEGER) AS year, tot_obs, CAST(sum(tot_obs) OVER (PARTITION BY park ORDER BY year) AS BIGINT) AS cumsum FROM fresh
"""
)
def species_curve(spark, sf):
    # first dates per part travel to the taxa, not the lines themselves
    research = S.lines(spark, sf).where(P.is_research())
    per_part = curves.first_date(research, ["park", "part_id"], "obs_date")
    named = per_part.join(S.taxa(spark, sf), "part_id").withColumn("species", F.struct("scientific_name", "family"))
    return curves.accumulation(named, "species", "obs_date", "park", new_name="tot_obs")


@query(
    f"""
WITH {S.SQL_LINES}, yearly AS (SELECT park, CAST(year(obs_date) AS INTEGER) AS year, count(*) AS n FROM lines GROUP BY ALL)
SELECT park, year, CAST(sum(n) OVER (PARTITION BY park ORDER BY year) AS BIGINT) AS cumsum FROM yearly
"""
)
def records_curve(spark, sf):
    return curves.records_curve(S.lines(spark, sf), "obs_date", "park")


@query(
    f"""
WITH {SQL_OBSERVER_CURVE}
SELECT park, year, last_value(cumsum IGNORE NULLS) OVER (PARTITION BY park ORDER BY year) AS cumsum
FROM (SELECT park, CAST(y AS INTEGER) AS year FROM (SELECT park, min(year) AS lo FROM observer_curve GROUP BY park),
      generate_series(1990, 2005) AS g(y) WHERE y >= lo)
LEFT JOIN observer_curve USING (park, year)
"""
)
def curve_filled_to_year(spark, sf):
    return curves.filled_to_year(observer_curve(spark, sf), "park", 2005)


@query(f"WITH {SQL_OBSERVER_CURVE} SELECT park, max(year) AS year, arg_max(cumsum, year) AS cumsum FROM observer_curve GROUP BY park")
def curve_last_point(spark, sf):
    return curves.last_point(observer_curve(spark, sf), "park")


@query(
    """
WITH a AS (SELECT year, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS cumsum_left FROM (
        SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem GROUP BY 1)),
b AS (SELECT year, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS cumsum_right FROM (
        SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1))
SELECT year, cumsum_left, cumsum_right, cumsum_left + cumsum_right AS cumsum FROM a LEFT JOIN b USING (year)
"""
)
def platform_combined_curve(spark, sf):
    left = curves.records_curve(S.lines(spark, sf), "obs_date")
    right = curves.records_curve(S.order_feed(spark, sf).where(P.from_year("observed_on", 1997)), "observed_on")
    return curves.combined_curves(left, right)


@query(
    """
WITH first_seen AS (
    SELECT 'species' AS kind, min(year(l_shipdate)) AS year FROM lineitem GROUP BY l_partkey
    UNION ALL SELECT 'observer', min(year(l_shipdate)) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
years AS (SELECT CAST(y AS INTEGER) AS year FROM generate_series(1990, 2001) AS g(y))
SELECT year, (SELECT count(*) FROM lineitem WHERE year(l_shipdate) <= years.year) AS total_observations,
       (SELECT count(*) FROM first_seen WHERE kind = 'species' AND first_seen.year <= years.year) AS total_spp,
       (SELECT count(*) FROM first_seen WHERE kind = 'observer' AND first_seen.year <= years.year) AS total_observers
FROM years
"""
)
def yearly_cumulative_totals(spark, sf):
    dated = S.lines(spark, sf).withColumn("obs_date", F.trunc("obs_date", "year"))
    reduced = counts.count_rows(dated, ["checklist_id", "part_id", "obs_date"], "k")
    full = reduced.join(S.headers(spark, sf).select("checklist_id", "observer_id"), "checklist_id")
    return curves.yearly_totals(full, "obs_date", "part_id", "observer_id", 1990, 2001, weight="k")


SQL_VISITS = """visits AS (
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS park, count(*) * 10 AS visits FROM orders
    WHERE NOT (o_orderstatus = 'O' AND year(o_orderdate) < 1997) GROUP BY ALL)"""


_OPENED = {"F": 0, "O": 1997, "P": 0}  # every status is a park


def _visits(spark, sf):
    """Visit counts in the wide shape of the input file, then long; the second park starts in 1997."""
    feed, year = S.order_feed(spark, sf), F.year("observed_on")
    counted = [F.nullif(F.count_if((F.col("park") == park) & (year >= first)) * 10, F.lit(0)).alias(park) for park, first in _OPENED.items()]
    yearly = feed.groupBy(year.alias("year")).agg(*counted)
    long = reshape.wide_to_long(yearly, ["year"], list(_OPENED), "park", "visits")
    return long.where(F.col("visits").isNotNull())


@query(f"WITH {SQL_VISITS} SELECT * FROM visits")
def visits_long(spark, sf):
    return _visits(spark, sf)


SQL_RATES = f"""{S.SQL_LINES}, {S.SQL_HEADERS}, {SQL_VISITS},
a AS (SELECT CAST(year(obs_date) AS INTEGER) AS year, park, count(DISTINCT observer_id) AS observers, count(*) AS observations
      FROM lines JOIN headers USING (checklist_id) GROUP BY ALL),
b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS park, count(DISTINCT o_custkey) AS observers, count(*) AS observations
      FROM orders GROUP BY ALL),
av AS (SELECT a.*, visits FROM a LEFT JOIN visits USING (year, park)),
bv AS (SELECT b.*, visits FROM b LEFT JOIN visits USING (year, park)),
rates AS (SELECT av.year, av.park, av.observers + bv.observers AS observers, av.observations + bv.observations AS observations, av.visits,
       (av.observers + bv.observers)::DOUBLE / av.visits::DOUBLE AS observers_vis,
       (av.observations + bv.observations)::DOUBLE / av.visits::DOUBLE AS observations_vis
    FROM av LEFT JOIN bv ON av.year = bv.year AND av.park = bv.park AND av.visits IS NOT DISTINCT FROM bv.visits
    WHERE av.year >= 1996)"""


def _rates(spark, sf):
    dated = S.lines(spark, sf).withColumn("year", F.year("obs_date"))
    per_list = counts.count_rows(dated, ["year", "park", "checklist_id"], "k")
    lines = per_list.join(S.headers(spark, sf).select("checklist_id", "observer_id"), "checklist_id")
    orders = S.order_feed(spark, sf).withColumn("year", F.year("observed_on"))
    return participation.visit_rates(
        participation.yearly_participation(lines, "observer_id", weight="k"),
        participation.yearly_participation(orders, "user_id"),
        _visits(spark, sf),
        first_year=1996,
    )


@query(f"WITH {SQL_RATES} SELECT * FROM rates")
def participation_per_visit(spark, sf):
    return _rates(spark, sf)


@query(
    f"""
WITH {SQL_RATES}
SELECT park, n, round(m1, 9) AS mean_observers, round(s1, 9) AS se_observers,
       round(m2, 9) AS mean_observations, round(s2, 9) AS se_observations,
       round(1 / m1, 9) AS observer_times, round(1 / m2, 9) AS observations_times
FROM (SELECT park, count(*) AS n,
             CASE WHEN count(observers_vis) = count(*) THEN avg(observers_vis) END AS m1,
             CASE WHEN count(observers_vis) = count(*) THEN stddev_samp(observers_vis) / sqrt(count(*)) END AS s1,
             CASE WHEN count(observations_vis) = count(*) THEN avg(observations_vis) END AS m2,
             CASE WHEN count(observations_vis) = count(*) THEN stddev_samp(observations_vis) / sqrt(count(*)) END AS s2
      FROM rates GROUP BY park)
"""
)
def participation_mean_se(spark, sf):
    means = participation.visit_rate_means(_rates(spark, sf))
    wanted = [c for c in means.columns if c not in ("park", "n", "observers_p", "observations_p")]
    return means.select("park", "n", *[F.round(c, 9).alias(c) for c in wanted])
