"""Queries: predicates, projections, counts and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.functions import names as N
from fieldtally.functions.values import count_from_text, message, ratio, zero_if_null
from fieldtally.operators import columns as C
from fieldtally.operators import counts, predicates as P, reshape
from fieldtally.plans import standin as S
from fieldtally.plans.registry import query

PROTOCOL_WORDS = {"traveling": S.TRAVELING, "stationary": S.STATIONARY, "incidental": S.INCIDENTAL}


@query(
    """
SELECT feed, park, count(*) AS n FROM (
    SELECT 'lines' AS feed, l_linestatus AS park FROM lineitem
    UNION ALL SELECT 'orders', o_orderstatus FROM orders)
GROUP BY feed, park
"""
)
def records_total_by_park(spark, sf):
    a = C.tag(S.lines(spark, sf).select("park"), feed="lines")
    b = C.tag(S.order_feed(spark, sf).select("park"), feed="orders")
    return counts.count_rows(reshape.stack(a, b), ["feed", "park"])


@query(
    """
SELECT DISTINCT p_name AS scientific_name, p_brand AS family FROM part WHERE p_partkey IN (
    SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
UNION
SELECT DISTINCT p_name, p_brand FROM part
"""
)
def species_list_union(spark, sf):
    seen = S.lines(spark, sf).where(P.is_research()).select("part_id").distinct()
    first = S.taxa(spark, sf).join(seen, "part_id", "left_semi")
    second = S.table(spark, sf, "part").select(
        F.col("p_name").alias("scientific_name"), F.col("p_brand").alias("family")
    )
    return reshape.distinct_union(["scientific_name", "family"], first, second)


@query(
    f"""
WITH {S.SQL_LINES}, named AS (
    SELECT p_partkey AS part_id,
           CASE p_brand WHEN 'Brand#13' THEN NULL WHEN 'Brand#14' THEN '' ELSE p_name END AS scientific_name FROM part)
SELECT park, count(*) AS n FROM lines JOIN named USING (part_id)
WHERE quality_grade = 'research' AND scientific_name IS NOT NULL AND scientific_name <> '' GROUP BY park
"""
)
def named_research_records(spark, sf):
    per_part = counts.count_rows(S.lines(spark, sf), ["park", "quality_grade", "part_id"], "k")
    name = F.when(F.col("family") == "Brand#13", F.lit(None)).when(F.col("family") == "Brand#14", "")
    named = S.taxa(spark, sf).select(
        "part_id", F.when(F.col("family").isin("Brand#13", "Brand#14"), name).otherwise(F.col("scientific_name")).alias("scientific_name")
    )
    kept = per_part.join(named, "part_id").where(P.is_named_research())
    return counts.group_sums(kept, "park", "k", "n")


@query(
    """
SELECT l_linestatus AS park, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem
WHERE CAST(l_shipdate AS DATE) <= DATE '2000-12-31' AND year(l_shipdate) >= 1997 GROUP BY ALL
"""
)
def cutoff_and_floor(spark, sf):
    kept = S.lines(spark, sf).where(P.on_or_before("obs_date", "2000-12-31") & P.from_year("obs_date", 1997))
    return counts.count_rows(kept.withColumn("year", F.year("obs_date")), ["park", "year"])


@query(
    """
SELECT p_brand AS family, count(*) AS n,
       CAST(count(*) FILTER (regexp_matches(name, 'ing$')) AS BIGINT) AS ending
FROM (SELECT p_brand, CASE WHEN p_size > 45 THEN NULL ELSE p_name END AS name FROM part)
WHERE name IS NULL OR NOT contains(name, 'widget') GROUP BY p_brand
"""
)
def regex_filtered_names(spark, sf):
    named = S.table(spark, sf, "part").select(
        F.col("p_brand").alias("family"), F.when(F.col("p_size") <= 45, F.col("p_name")).alias("name")
    )
    kept = named.where(~P.has_text("name", "widget"))
    return kept.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(P.matches("name", "ing$")).alias("ending")
    )


@query(
    """
SELECT event_type, count(*) AS records, count(DISTINCT u) + max(CASE WHEN u IS NULL THEN 1 ELSE 0 END) AS participants
FROM (SELECT event_type, nullif(user_id, 8) AS u FROM events) GROUP BY event_type
"""
)
def participants_per_group(spark, sf):
    events = S.table(spark, sf, "events").select("event_type", F.nullif("user_id", F.lit(8)).alias("u"))
    grouped = counts.count_distinct(events, "u", "event_type", "participants", rows_name="records")
    return grouped.orderBy(F.desc("participants"), "event_type")


@query("SELECT DISTINCT o_orderstatus AS park, o_custkey AS user_id FROM orders")
def distinct_observers(spark, sf):
    return counts.distinct_keys(S.order_feed(spark, sf), ["park", "user_id"])


@query(
    """
SELECT o_orderstatus AS orderstatus, o_totalprice AS totalprice, 'orders' AS feed,
       CAST(NULL AS DOUBLE) AS accuracy, CAST(0 AS DOUBLE) AS accuracy_filled, o_orderkey AS checklist_id,
       o_orderstatus || ' - ' || o_orderpriority AS path, o_totalprice / 1000.0::DOUBLE AS price_thousands,
       'order ' || CAST(o_orderkey AS VARCHAR) || ' by ' || CAST(o_custkey AS VARCHAR) AS note
FROM orders
"""
)
def aligned_columns(spark, sf):
    orders = C.normalise_names(S.table(spark, sf, "orders").withColumnsRenamed({"o_orderkey": "O ORDERKEY "}), "_")
    front = C.move_to_front(orders, C.column_range(orders, "o_orderstatus", "o_totalprice"))
    named = C.rename(front, {"o_orderkey": "checklist_id", "o_orderstatus": "orderstatus", "o_totalprice": "totalprice"})
    tagged = C.with_null_columns(C.tag(named, feed="orders"), {"accuracy": "double"})
    labelled = tagged.withColumns(
        {
            "accuracy_filled": zero_if_null("accuracy"),
            "path": C.path_label("orderstatus", "o_orderpriority"),
            "price_thousands": F.col("totalprice") / 1000.0,
            "note": message("order %s by %s", "checklist_id", "o_custkey"),
        }
    )
    return C.drop_range(labelled, "o_custkey", "o_orderpriority")


def _completeness_sql(condition: str) -> str:
    return f"""
WITH {S.SQL_LINES}, {S.SQL_HEADERS}
SELECT park, count(*) AS records, count(*) FILTER ({condition}) AS complete_records,
       count(DISTINCT checklist_id) AS checklists,
       count(DISTINCT checklist_id) FILTER ({condition}) AS complete_checklists,
       count(DISTINCT observer_id) AS observers,
       count(DISTINCT checklist_id)::DOUBLE / count(DISTINCT observer_id)::DOUBLE AS checklists_per_observer,
       count(DISTINCT checklist_id) FILTER ({condition})::DOUBLE / count(DISTINCT checklist_id)::DOUBLE * 100.0::DOUBLE AS percent_complete
FROM lines JOIN headers USING (checklist_id) GROUP BY park
"""


SQL_COMPLETE = f"duration_min >= 5 AND all_species_reported = 1 AND protocol <> '{S.INCIDENTAL}'"


def _completeness(spark, sf, rule):
    reduced = S.reduced_lines_with_headers(spark, sf, "park")
    complete = P.is_complete(rule=rule, **PROTOCOL_WORDS)
    return counts.completeness_summary(reduced, "checklist_id", "observer_id", complete, "park", weight="k")


@query(_completeness_sql(SQL_COMPLETE))
def checklist_completeness(spark, sf):
    return _completeness(spark, sf, "standard")


@query(
    _completeness_sql(
        f"protocol = '{S.TRAVELING}' OR (protocol = '{S.STATIONARY}' AND duration_min >= 5 AND all_species_reported = 1)"
    )
)
def checklist_completeness_protocol(spark, sf):
    return _completeness(spark, sf, "protocol")


@query(_completeness_sql(f"protocol = '{S.TRAVELING}' OR (protocol = '{S.STATIONARY}' AND duration_min >= 5)"))
def checklist_completeness_richness(spark, sf):
    return _completeness(spark, sf, "richness")


@query(
    f"""
WITH {S.SQL_LINES}, {S.SQL_HEADERS}, chk AS (SELECT * FROM lines JOIN headers USING (checklist_id)),
o AS (SELECT count(*) AS obs_records, count(DISTINCT o_custkey) AS obs_observers,
             count(*) FILTER (o_orderstatus = 'F') AS research_records,
             count(*) FILTER (o_orderstatus <> 'P') AS species_level_records FROM orders),
c AS (SELECT count(*) AS chk_records, count(*) FILTER ({SQL_COMPLETE}) AS complete_records,
             count(DISTINCT checklist_id) AS checklists,
             count(DISTINCT checklist_id) FILTER ({SQL_COMPLETE}) AS complete_checklists,
             count(DISTINCT observer_id) AS chk_observers FROM chk)
SELECT *, obs_records + chk_records AS records, obs_observers + chk_observers AS observers,
       obs_records::DOUBLE / obs_observers::DOUBLE AS records_per_observer,
       obs_records::DOUBLE / (obs_records + chk_records)::DOUBLE * 100.0::DOUBLE AS percent_observation_feed,
       chk_records::DOUBLE / (obs_records + chk_records)::DOUBLE * 100.0::DOUBLE AS percent_checklist_feed,
       research_records::DOUBLE / obs_records::DOUBLE * 100.0::DOUBLE AS percent_research,
       species_level_records::DOUBLE / obs_records::DOUBLE * 100.0::DOUBLE AS percent_species_level,
       (research_records + complete_records)::DOUBLE / (obs_records + chk_records)::DOUBLE * 100.0::DOUBLE AS percent_ready_records,
       (research_records + complete_checklists)::DOUBLE / (obs_records + checklists)::DOUBLE * 100.0::DOUBLE AS percent_ready_units
FROM o, c
"""
)
def two_feed_totals(spark, sf):
    obs = S.order_feed(spark, sf)
    chk = S.reduced_lines_with_headers(spark, sf)
    complete = P.is_complete(**PROTOCOL_WORDS)
    return counts.two_feed_summary(obs, chk, F.col("park") == "F", complete, F.col("park") != "P", weight="k")


@query(
    f"""
WITH {S.SQL_LINES}, {S.SQL_HEADERS}, chk AS (SELECT * FROM lines JOIN headers USING (checklist_id)),
a AS (SELECT o_orderstatus AS park, count(*) AS obs_records, count(*) FILTER (year(o_orderdate) < 1998) AS research_records,
             count(DISTINCT o_custkey) AS obs_observers,
             count(*) FILTER (o_orderpriority <> '3-MEDIUM') AS species_level_records FROM orders GROUP BY 1),
b AS (SELECT park, count(*) AS chk_records, count(*) FILTER ({SQL_COMPLETE}) AS complete_records,
             count(DISTINCT checklist_id) AS checklists,
             count(DISTINCT checklist_id) FILTER ({SQL_COMPLETE}) AS complete_checklists,
             count(DISTINCT observer_id) AS chk_observers FROM chk GROUP BY 1),
ab AS (SELECT park, coalesce(obs_records, 0) AS obs_records, coalesce(research_records, 0) AS research_records,
              coalesce(obs_observers, 0) AS obs_observers, coalesce(species_level_records, 0) AS species_level_records,
              coalesce(chk_records, 0) AS chk_records, coalesce(complete_records, 0) AS complete_records,
              coalesce(checklists, 0) AS checklists, coalesce(complete_checklists, 0) AS complete_checklists,
              coalesce(chk_observers, 0) AS chk_observers FROM a FULL JOIN b USING (park))
SELECT *, obs_records + chk_records AS records, obs_observers + chk_observers AS observers,
       obs_records::DOUBLE / nullif(obs_observers, 0)::DOUBLE AS records_per_observer,
       obs_records::DOUBLE / (obs_records + chk_records)::DOUBLE * 100.0::DOUBLE AS percent_observation_feed,
       chk_records::DOUBLE / (obs_records + chk_records)::DOUBLE * 100.0::DOUBLE AS percent_checklist_feed,
       research_records::DOUBLE / nullif(obs_records, 0)::DOUBLE * 100.0::DOUBLE AS percent_research,
       species_level_records::DOUBLE / nullif(obs_records, 0)::DOUBLE * 100.0::DOUBLE AS percent_species_level,
       (research_records + complete_records)::DOUBLE / (obs_records + chk_records)::DOUBLE * 100.0::DOUBLE AS percent_ready_records,
       (research_records + complete_checklists)::DOUBLE / (obs_records + checklists)::DOUBLE * 100.0::DOUBLE AS percent_ready_units
FROM ab
"""
)
def two_feed_totals_by_park(spark, sf):
    """Each park's own totals; one of the parks has no checklists."""
    research, named = F.year("observed_on") < 1998, F.col("place_guess") != "3-MEDIUM"
    chk = S.reduced_lines_with_headers(spark, sf, "park")
    complete = P.is_complete(**PROTOCOL_WORDS)
    return counts.two_feed_summary(S.order_feed(spark, sf), chk, research, complete, named, weight="k", by="park")


@query(
    """
SELECT o_orderstatus AS park, count(*) AS n FROM orders WHERE o_totalprice < 50000 GROUP BY o_orderstatus
"""
)
def accurate_points(spark, sf):
    return counts.count_rows(S.order_feed(spark, sf).where(P.accurate_within("positional_accuracy", 50000.0)), "park")


@query(
    f"""
WITH {S.SQL_LINES}
SELECT park, count(*) AS n, min(longitude) AS west, max(longitude) AS east FROM lines
WHERE longitude BETWEEN 20 AND 60.5 AND latitude BETWEEN 10 AND 30 GROUP BY park
"""
)
def bbox_clip(spark, sf):
    kept = S.lines(spark, sf).where(P.in_box("longitude", "latitude", 20.0, 60.5, 10.0, 30.0))
    return kept.groupBy("park").agg(
        F.count(F.lit(1)).alias("n"), F.min("longitude").alias("west"), F.max("longitude").alias("east")
    )


@query(
    """
SELECT locality, count(*) AS n FROM (
    SELECT CASE WHEN l_orderkey = 98 THEN 'relabelled' ELSE 'site ' || CAST(l_suppkey AS VARCHAR) END AS locality FROM lineitem)
WHERE locality <> 'site 7' GROUP BY locality
"""
)
def hotspot_excluded(spark, sf):
    located = S.lines(spark, sf).withColumn("locality", F.concat(F.lit("site "), F.col("site_id").cast("string")))
    moved = located.withColumn("locality", P.relabelled("locality", "checklist_id", [98], "relabelled"))
    return counts.count_rows(moved.where(P.not_hotspot("locality", "site 7")), "locality")


@query(
    """
SELECT l_returnflag AS flag, count(*) AS n FROM lineitem
WHERE CAST(l_shipdate AS DATE) > DATE '1998-01-23' AND CAST(l_shipdate AS DATE) < DATE '1998-12-24' GROUP BY l_returnflag
"""
)
def open_interval(spark, sf):
    dated = S.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_shipdate").cast("date").alias("d"))
    return counts.count_rows(dated.where(P.in_period("d", "1998-01-23", "1998-12-24", closed=False)), "flag")


@query(
    """
SELECT l_linestatus AS park, count(*) AS n, count(DISTINCT l_orderkey) AS checklists FROM lineitem
WHERE l_orderkey NOT IN (98, 580, 5979) GROUP BY l_linestatus
"""
)
def bad_ids_removed(spark, sf):
    kept = S.lines(spark, sf).where(P.not_among("checklist_id", [98, 580, 5979]))
    return counts.count_distinct(kept, "checklist_id", "park", "checklists", rows_name="n")


@query(
    """
SELECT p_partkey AS part_id, split_part(name, ' ', 1) AS genus,
       CASE WHEN split_part(name, ' ', 2) NOT IN ('', '×') THEN split_part(name, ' ', 2) END AS epithet,
       nullif(split_part(name, ' ', 3), '') AS infra,
       concat_ws(' ', split_part(name, ' ', 1), CASE WHEN split_part(name, ' ', 2) NOT IN ('', '×') THEN split_part(name, ' ', 2) END) AS binomial,
       regexp_replace(name, '\\s\\w*', '') AS short
FROM (SELECT p_partkey, CASE WHEN p_size <= 5 THEN split_part(p_name, ' ', 1)
                             WHEN p_size <= 10 THEN replace(p_name, ' ', ' × ')
                             WHEN p_size <= 30 THEN p_name ELSE p_name || ' ' || lower(p_type) END AS name FROM part)
"""
)
def name_parts(spark, sf):
    size, plain = F.col("p_size"), F.col("p_name")
    name = (
        F.when(size <= 5, F.split_part(plain, F.lit(" "), F.lit(1)))
        .when(size <= 10, F.replace(plain, F.lit(" "), F.lit(" × ")))
        .when(size <= 30, plain)
        .otherwise(F.concat_ws(" ", plain, F.lower("p_type")))
    )
    named = S.table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"), name.alias("name"))
    split = named.select(
        "part_id",
        N.genus("name").alias("genus"),
        N.epithet("name").alias("epithet"),
        N.infraspecific("name").alias("infra"),
        N.drop_first_word("name").alias("short"),
    )
    return split.withColumn("binomial", N.binomial("genus", "epithet"))


@query(
    """
SELECT CASE p_name WHEN 'red bolt' THEN 'red rivet' WHEN 'old gear' THEN 'old cog' WHEN 'hot rod' THEN 'warm rod' ELSE p_name END AS scientific_name,
       count(*) AS n FROM part GROUP BY 1
"""
)
def synonym_recode(spark, sf):
    renames = {"red bolt": "red rivet", "old gear": "old cog", "hot rod": "warm rod"}
    taxa = S.taxa(spark, sf).select(N.recode("scientific_name", renames).alias("scientific_name"))
    return counts.count_rows(taxa, "scientific_name")


@query(
    """
SELECT iconic, count(*) AS count FROM (
    SELECT CASE WHEN g IN ('Insecta', 'Mammalia', 'Aves', 'Amphibia', 'Actinopterygii', 'Mollusca', 'Reptilia', 'Arachnida')
                THEN 'Animalia' ELSE g END AS iconic
    FROM (SELECT CASE p_type WHEN 'ECONOMY' THEN 'Insecta' WHEN 'LARGE' THEN 'Mammalia' WHEN 'STANDARD' THEN 'Aves'
                             WHEN 'PROMO' THEN 'Plantae' WHEN 'SMALL' THEN 'Fungi' ELSE '' END AS g
          FROM lineitem JOIN part ON l_partkey = p_partkey)) GROUP BY iconic
"""
)
def coarse_taxon_recode(spark, sf):
    groups = {"ECONOMY": "Insecta", "LARGE": "Mammalia", "STANDARD": "Aves", "PROMO": "Plantae", "SMALL": "Fungi", "MEDIUM": ""}
    per_part = counts.count_rows(S.lines(spark, sf), "part_id", "k")
    iconic = S.taxa(spark, sf).select("part_id", N.kingdom_of_group(N.recode("order", groups)).alias("iconic"))
    return counts.ranked_counts(per_part.join(iconic, "part_id"), "iconic", "count", weight="k")


@query(
    """
SELECT l_linestatus AS park, count(*) AS n, count(c) AS counted, CAST(sum(CAST(c AS BIGINT)) AS BIGINT) AS individuals
FROM (SELECT l_linestatus, CASE l_linenumber WHEN 7 THEN 1.0 WHEN 6 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) END AS c
      FROM lineitem) GROUP BY l_linestatus
"""
)
def count_text_coerce(spark, sf):
    counted = S.lines(spark, sf).withColumn("c", count_from_text("count_text"))
    return counted.groupBy("park").agg(
        F.count(F.lit(1)).alias("n"), F.count("c").alias("counted"), F.sum(F.col("c").cast("bigint")).alias("individuals")
    )


@query(
    """
SELECT p_brand AS family, count(*) AS n FROM part GROUP BY p_brand
"""
)
def family_label_clean(spark, sf):
    # a label such as "Brand#7 (LARGE)" loses its bracketed part
    label = F.concat(F.col("family"), F.lit(" ("), F.col("order"), F.lit(")"))
    return counts.count_rows(S.taxa(spark, sf).select(N.strip_bracketed(label).alias("family")), "family")


@query(
    f"""
WITH {S.SQL_LINES}
SELECT park, quality_grade, count(*) AS n, count(*)::DOUBLE / count(DISTINCT checklist_id)::DOUBLE AS per_checklist
FROM lines GROUP BY park, quality_grade
"""
)
def records_per_checklist_ratio(spark, sf):
    grouped = counts.count_distinct(S.lines(spark, sf), "checklist_id", ["park", "quality_grade"], "units", rows_name="n")
    return grouped.select("park", "quality_grade", "n", ratio("n", "units").alias("per_checklist"))
