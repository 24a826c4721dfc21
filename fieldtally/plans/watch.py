"""Queries: watch-list classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.operators import counts, predicates as P, reshape, watchlist as W
from fieldtally.plans import standin as S
from fieldtally.plans.registry import query

SQL_FEED = f"""{S.SQL_LINES}, {S.SQL_TAXA}, {S.SQL_WATCH}, {S.SQL_STATUS}, feed AS (
    SELECT scientific_name, family AS common_name, obs_date AS observed_on, 'site ' || CAST(site_id AS VARCHAR) AS place_guess,
           latitude, longitude, CASE WHEN line = 3 THEN NULL ELSE duration_min * 2 END AS positional_accuracy,
           CASE WHEN quality_grade = 'research' THEN 'record/' || CAST(checklist_id AS VARCHAR) END AS url
    FROM lines JOIN taxa USING (part_id))"""
SQL_INVASIVE = """invasive AS (
    SELECT feed.* FROM feed WHERE scientific_name IN (SELECT scientific_name FROM watch
        WHERE category IN ('invasive not established', 'invasive established', 'pest disease'))
    UNION ALL
    SELECT feed.* FROM feed WHERE regexp_replace(scientific_name, '\\s\\w*', '') IN (
        SELECT regexp_replace(scientific_name, '\\s\\w*\\.', '') FROM watch WHERE regexp_matches(scientific_name, 'spp.$')))"""
SQL_TABLE = f"""{SQL_INVASIVE}, tally AS (
    SELECT scientific_name, count(*) AS count, 'pest/invasive' AS category FROM invasive GROUP BY scientific_name
    UNION ALL
    SELECT scientific_name, count(*), 'threatened/endangered' FROM feed JOIN status USING (scientific_name) GROUP BY scientific_name
    UNION ALL
    SELECT scientific_name, count(*), 'rare native' FROM feed WHERE scientific_name IN (
        SELECT scientific_name FROM watch WHERE category = 'species of interest') GROUP BY scientific_name)"""


def _feed(spark, sf):
    return S.lines_with_taxa(spark, sf).select(
        "scientific_name",
        F.col("family").alias("common_name"),
        F.col("obs_date").alias("observed_on"),
        F.concat(F.lit("site "), F.col("site_id").cast("string")).alias("place_guess"),
        "latitude",
        "longitude",
        F.when(F.col("line") != 3, F.col("duration_min") * 2).alias("positional_accuracy"),
        F.when(P.is_research(), F.concat(F.lit("record/"), F.col("checklist_id").cast("string"))).alias("url"),
    )


def _tallies(spark, sf, lines=None):
    """Tallies over the whole feed, from counts per part."""
    per_part = counts.count_rows(lines if lines is not None else S.lines(spark, sf), "part_id", "k")
    named = per_part.join(S.taxa(spark, sf), "part_id").select("scientific_name", "k")
    return W.tallies(named, S.status_list(spark), S.watch_list(spark), weight="k")


@query(
    f"""
WITH {SQL_FEED}
SELECT scientific_name, common_name, observed_on, place_guess AS location, listing_status, latitude, longitude, url
FROM feed JOIN status USING (scientific_name)
"""
)
def watch_threatened(spark, sf):
    return W.threatened(_feed(spark, sf), S.status_list(spark))


@query(
    f"""
WITH {SQL_FEED}
SELECT scientific_name, common_name, observed_on, place_guess AS location, latitude, longitude, positional_accuracy, url
FROM feed WHERE scientific_name IN (SELECT scientific_name FROM watch WHERE category = 'species of interest')
"""
)
def watch_rare(spark, sf):
    return W.rare(_feed(spark, sf), S.watch_list(spark))


@query(f"WITH {SQL_FEED}, {SQL_INVASIVE} SELECT * FROM invasive")
def watch_invasive(spark, sf):
    return W.invasive(_feed(spark, sf), S.watch_list(spark))


@query(
    f"""
WITH {SQL_FEED}, {SQL_INVASIVE}
SELECT feed.*, 'threatened/endangered' AS list, listing_status FROM feed JOIN status USING (scientific_name)
UNION ALL BY NAME
SELECT *, 'rare native' AS list FROM feed
WHERE scientific_name IN (SELECT scientific_name FROM watch WHERE category = 'species of interest')
UNION ALL BY NAME
SELECT *, 'pest/invasive' AS list FROM invasive
"""
)
def watch_all_lists(spark, sf):
    return W.classify(_feed(spark, sf), S.status_list(spark), S.watch_list(spark))


@query(f"WITH {SQL_FEED}, {SQL_TABLE} SELECT * FROM tally")
def watch_table(spark, sf):
    return W.report_order(_tallies(spark, sf))


@query(f"WITH {SQL_FEED}, {SQL_TABLE} SELECT category, CAST(sum(count) AS BIGINT) AS sum FROM tally GROUP BY category")
def watch_list_totals(spark, sf):
    return W.list_totals(_tallies(spark, sf))


@query(
    f"""
WITH {SQL_FEED}, {SQL_TABLE}
SELECT count(*) AS listed, count(*) FILTER (seen) AS detected, count(*) FILTER (seen)::DOUBLE / count(*)::DOUBLE AS rate
FROM (SELECT scientific_name IN (SELECT scientific_name FROM tally) AS seen FROM watch WHERE in_park = 'Y')
"""
)
def watch_detection_rate(spark, sf):
    return W.detection_rate(W.detection(S.watch_list(spark), _tallies(spark, sf), ["Y"]))


@query(
    f"""
WITH {SQL_FEED}, {SQL_TABLE}
SELECT scientific_name, category, in_park, 'yes' AS detected FROM watch
WHERE in_park IN ('N', 'U') AND scientific_name IN (SELECT scientific_name FROM tally)
"""
)
def watch_unexpected_species(spark, sf):
    flags = W.detection(S.watch_list(spark), _tallies(spark, sf), ["N", "U"])
    return flags.where("detected = 'yes'").select("scientific_name", "category", "in_park", "detected")


@query(
    f"""
WITH {SQL_FEED.replace("FROM lines JOIN taxa", "FROM (SELECT * FROM lines WHERE obs_date > DATE '1998-01-23' AND obs_date < DATE '1998-12-24') JOIN taxa")}, {SQL_TABLE}
SELECT category, CAST(sum(count) AS BIGINT) AS sum FROM tally GROUP BY category
"""
)
def watch_period_stats(spark, sf):
    inside = S.lines(spark, sf).where(P.in_period("obs_date", "1998-01-23", "1998-12-24", closed=False))
    return W.list_totals(_tallies(spark, sf, inside))


@query(
    f"""
WITH {S.SQL_LINES}, {S.SQL_TAXA}, stacked AS (
    SELECT p_name AS scientific_name, CAST(NULL AS DOUBLE) AS positional_accuracy FROM part
    UNION ALL SELECT scientific_name, duration_min FROM lines JOIN taxa USING (part_id) WHERE quality_grade = 'research')
SELECT count(*) AS n, count(positional_accuracy) AS located, count(DISTINCT scientific_name) AS species FROM stacked
"""
)
def watch_combined_feed(spark, sf):
    """Research-grade observations over checklist lines that have no accuracy and no link."""
    obs = S.lines_with_taxa(spark, sf).select(
        "quality_grade",
        "scientific_name",
        F.col("family").alias("common_name"),
        F.col("obs_date").alias("observed_on"),
        F.lit("here").alias("place_guess"),
        "latitude",
        "longitude",
        F.col("duration_min").alias("positional_accuracy"),
        F.lit("link").alias("url"),
    )
    chk = S.taxa(spark, sf).select(
        "scientific_name",
        F.col("family").alias("common_name"),
        F.lit("2000-01-01").cast("date").alias("obs_date"),
        F.lit("there").alias("locality"),
        F.lit(1.0).alias("latitude"),
        F.lit(1.0).alias("longitude"),
    )
    feed = W.combined_feed(obs, chk)
    per_name = feed.groupBy("scientific_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("positional_accuracy").alias("located")
    )
    return per_name.agg(F.sum("n").alias("n"), F.sum("located").alias("located"), F.count(F.lit(1)).alias("species"))


SQL_PARK_TABLE = """named AS (SELECT park, scientific_name FROM lines JOIN taxa USING (part_id)),
lists AS (
    SELECT 'O' AS park, scientific_name, category, in_park FROM watch
    UNION ALL
    SELECT 'F', p_name, CASE WHEN p_size < 5 THEN 'species of interest' WHEN p_size < 15 THEN 'pest disease' ELSE 'native' END,
           CASE WHEN p_retailprice < 1200 THEN 'Y' ELSE 'U' END FROM part),
tally AS (
    SELECT park, scientific_name, count(*) AS count, 'pest/invasive' AS category FROM (
        SELECT * FROM named WHERE (park, scientific_name) IN (SELECT (park, scientific_name) FROM lists
            WHERE category IN ('invasive not established', 'invasive established', 'pest disease'))
        UNION ALL
        SELECT * FROM named WHERE (park, regexp_replace(scientific_name, '\\s\\w*', '')) IN (
            SELECT (park, regexp_replace(scientific_name, '\\s\\w*\\.', '')) FROM lists WHERE regexp_matches(scientific_name, 'spp.$')))
    GROUP BY park, scientific_name
    UNION ALL
    SELECT park, scientific_name, count(*), 'threatened/endangered' FROM named JOIN status USING (scientific_name) GROUP BY park, scientific_name
    UNION ALL
    SELECT park, scientific_name, count(*), 'rare native' FROM named WHERE (park, scientific_name) IN (
        SELECT (park, scientific_name) FROM lists WHERE category = 'species of interest') GROUP BY park, scientific_name)"""


def _park_lists(spark, sf):
    """The short list of one park, and a list as long as the table of parts of another."""
    size = F.col("p_size")
    long_list = S.table(spark, sf, "part").select(
        F.col("p_name").alias("scientific_name"),
        F.when(size < 5, W.RARE_CATEGORY).when(size < 15, "pest disease").otherwise("native").alias("category"),
        F.when(F.col("p_retailprice") < 1200, "Y").otherwise("U").alias("in_park"),
    )
    return W.by_park({"O": S.watch_list(spark), "F": long_list})


def _tallies_by_park(spark, sf, lists):
    per_part = counts.count_rows(S.lines(spark, sf), ["park", "part_id"], "k")
    named = per_part.join(S.taxa(spark, sf), "part_id").select("park", "scientific_name", "k")
    return W.tallies(named, S.status_list(spark), lists, weight="k", by="park")


@query(f"WITH {S.SQL_LINES}, {S.SQL_TAXA}, {S.SQL_WATCH}, {S.SQL_STATUS}, {SQL_PARK_TABLE} SELECT * FROM tally")
def watch_table_by_park(spark, sf):
    """Tallies of every park against its own list, from one scan."""
    return _tallies_by_park(spark, sf, _park_lists(spark, sf))


@query(
    f"""
WITH {S.SQL_LINES}, {S.SQL_TAXA}, {S.SQL_WATCH}, {S.SQL_STATUS}, {SQL_PARK_TABLE}
SELECT park, count(*) AS listed, count(*) FILTER (seen) AS detected, count(*) FILTER (seen)::DOUBLE / count(*)::DOUBLE AS rate
FROM (SELECT park, (park, scientific_name) IN (SELECT (park, scientific_name) FROM tally) AS seen FROM lists WHERE in_park = 'Y')
GROUP BY park
"""
)
def watch_detection_rate_by_park(spark, sf):
    lists = _park_lists(spark, sf)
    return W.detection_rate(W.detection(lists, _tallies_by_park(spark, sf, lists), ["Y"], by="park"), by="park")
