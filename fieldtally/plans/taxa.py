"""Queries: taxonomy joins, shares, frequencies, hierarchies, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.functions.values import ratio
from fieldtally.operators import counts, predicates as P, reshape, taxonomy
from fieldtally.plans import standin as S
from fieldtally.plans.registry import query

# One rank is blank and one is missing, as in real taxonomy lists.
SQL_RANKS = """ranks AS (
    SELECT p_partkey AS part_id, p_name AS scientific_name,
           CASE p_type WHEN 'PROMO' THEN '' ELSE p_type END AS "order",
           CASE p_brand WHEN 'Brand#13' THEN NULL WHEN 'Brand#14' THEN '' ELSE p_brand END AS family FROM part)"""


def _ranks(spark, sf):
    family = F.col("family")
    return S.taxa(spark, sf).select(
        "part_id",
        "scientific_name",
        F.when(F.col("order") == "PROMO", "").otherwise(F.col("order")).alias("order"),
        F.when(family == "Brand#14", "").when(family != "Brand#13", family).alias("family"),
    )


@query(
    f"""
WITH {SQL_RANKS}
SELECT "order", count(*) AS n, (SELECT count(*) FROM lineitem) AS total,
       count(*)::DOUBLE / (SELECT count(*) FROM lineitem)::DOUBLE * 100.0::DOUBLE AS percent
FROM lineitem JOIN ranks ON l_partkey = part_id WHERE "order" <> '' GROUP BY "order"
"""
)
def order_share(spark, sf):
    per_order = taxonomy.counts_by_rank(S.lines(spark, sf), _ranks(spark, sf), "order", key="part_id")
    return counts.share_of_total(per_order, keep=P.all_filled("order"), digits=None, total_name="total")


@query(
    f"""
WITH {SQL_RANKS}
SELECT "order", count(*) AS n, round_even(count(*)::DOUBLE / (SELECT count(*) FROM lineitem)::DOUBLE * 100.0::DOUBLE, 2)::DOUBLE AS percent
FROM lineitem JOIN ranks ON l_partkey = part_id WHERE "order" <> '' GROUP BY "order"
"""
)
def order_share_rounded(spark, sf):
    per_order = taxonomy.counts_by_rank(S.lines(spark, sf), _ranks(spark, sf), "order", key="part_id")
    return counts.share_of_total(per_order, keep=P.all_filled("order")).orderBy(F.desc("n"), "order")


@query(
    f"""
WITH {SQL_RANKS}, feed AS (SELECT l_linestatus AS park, count(*) AS total FROM lineitem GROUP BY park)
SELECT park, "order", count(*) AS n, any_value(total) AS total,
       count(*)::DOUBLE / any_value(total)::DOUBLE * 100.0::DOUBLE AS percent
FROM lineitem JOIN ranks ON l_partkey = part_id JOIN feed ON l_linestatus = park WHERE "order" <> '' GROUP BY park, "order"
"""
)
def order_share_by_park(spark, sf):
    lines = S.lines(spark, sf)
    per_order = taxonomy.counts_by_rank(lines, _ranks(spark, sf), "order", by="park", key="part_id")
    return counts.share_of_total(
        per_order, keep=P.all_filled("order"), digits=None, total_name="total", by="park", feed=lines
    )


@query(
    """
WITH units AS (SELECT l_linestatus AS park, count(DISTINCT l_orderkey) AS units FROM lineitem GROUP BY park)
SELECT park, l_suppkey AS site_id, count(*) AS n, any_value(units) AS units,
       count(*)::DOUBLE / any_value(units)::DOUBLE * 100.0::DOUBLE AS frequency
FROM lineitem JOIN units ON l_linestatus = park GROUP BY park, site_id
"""
)
def site_frequency_by_park(spark, sf):
    return counts.frequency_by_taxon(S.lines(spark, sf), "site_id", "checklist_id", digits=None, by="park")


@query(
    """
SELECT scientific_name, family, count(*) AS n, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS units,
       count(*)::DOUBLE / (SELECT count(DISTINCT l_orderkey) FROM lineitem)::DOUBLE * 100.0::DOUBLE AS frequency
FROM (SELECT p_name AS scientific_name, p_brand AS family FROM lineitem JOIN part ON l_partkey = p_partkey)
GROUP BY scientific_name, family
"""
)
def taxon_frequency(spark, sf):
    lines = S.lines(spark, sf)
    per_part = counts.frequency_by_taxon(lines, "part_id", "checklist_id", digits=None)
    named = per_part.join(S.taxa(spark, sf), "part_id")
    summed = named.groupBy("scientific_name", "family").agg(F.sum("n").alias("n"), F.max("units").alias("units"))
    return summed.withColumn("frequency", ratio("n", "units") * 100.0)


@query(
    """
SELECT l_suppkey AS site_id, count(*) AS n, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS units,
       count(*)::DOUBLE / (SELECT count(DISTINCT l_orderkey) FROM lineitem)::DOUBLE * 100.0::DOUBLE AS frequency
FROM lineitem GROUP BY l_suppkey
"""
)
def site_frequency(spark, sf):
    return counts.frequency_by_taxon(S.lines(spark, sf), "site_id", "checklist_id", digits=None)


SQL_KINGDOMS = """kingdoms AS (
    SELECT c_mktsegment AS kingdom, l_returnflag = 'R' AS hit FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def _kingdom_rates(spark, sf):
    """Rows and research rows per kingdom: counted per checklist, then per observer, then joined on."""
    per_list = counts.rate_by_group(S.lines(spark, sf), "checklist_id", P.is_research(), rate_name=None)
    per_observer = counts.rolled_up_rates(
        per_list.join(S.headers(spark, sf).select("checklist_id", "observer_id"), "checklist_id"),
        "observer_id",
        rate_name=None,
    )
    observers = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("observer_id"), F.col("c_mktsegment").alias("kingdom")
    )
    return per_observer.join(observers, "observer_id")


@query(
    f"""
WITH {SQL_KINGDOMS}
SELECT kingdom, count(*) AS total_obs, count(*) FILTER (hit) AS rg_obs,
       round_even(count(*) FILTER (hit)::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE, 0)::DOUBLE AS percent_rg
FROM kingdoms GROUP BY kingdom
"""
)
def grade_rate_by_kingdom(spark, sf):
    return counts.rolled_up_rates(_kingdom_rates(spark, sf), "kingdom").orderBy(F.desc("percent_rg"), "kingdom")


@query(
    """
SELECT l_linestatus AS park, l_shipdate < TIMESTAMP '1998-01-01' AS early, count(*) AS total_obs,
       count(*) FILTER (l_returnflag = 'R') AS rg_obs,
       round_even(count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE, 0)::DOUBLE AS percent_rg
FROM lineitem GROUP BY ALL
"""
)
def grade_rate_by_park(spark, sf):
    lines = S.lines(spark, sf).withColumn("early", F.col("obs_date") < F.lit("1998-01-01").cast("date"))
    return counts.rate_by_group(lines, ["park", "early"], P.is_research())


@query(
    f"""
WITH {SQL_KINGDOMS},
a AS (SELECT kingdom, count(*) AS total, row_number() OVER (ORDER BY count(*) DESC, kingdom) AS position FROM kingdoms GROUP BY kingdom),
b AS (SELECT kingdom, count(*) FILTER (hit) AS hits, row_number() OVER (ORDER BY count(*) FILTER (hit) DESC, kingdom) AS position FROM kingdoms GROUP BY kingdom)
SELECT a.kingdom AS kingdom_left, total, b.kingdom AS kingdom_right, hits, CAST(position AS INTEGER) AS position FROM a JOIN b USING (position)
"""
)
def kingdom_positional_pair(spark, sf):
    rates = counts.rolled_up_rates(_kingdom_rates(spark, sf), "kingdom", rate_name=None)
    totals = rates.select("kingdom", F.col("total_obs").alias("total"))
    hits = rates.select("kingdom", F.col("rg_obs").alias("hits"))
    return reshape.pair_by_position(
        totals, hits, [F.desc("total"), "kingdom"], [F.desc("hits"), "kingdom"]
    )


@query(
    """
SELECT event_type AS kingdom, count(*) FILTER (value > 20) AS hits, count(*) AS total FROM events GROUP BY event_type
"""
)
def kingdom_key_pair(spark, sf):
    events = S.table(spark, sf, "events").select(F.col("event_type").alias("kingdom"), "value")
    return taxonomy.grade_share_by_key(events, "kingdom", F.col("value") > 20)


@query(
    f"""
WITH {SQL_RANKS}
SELECT "order", count(DISTINCT scientific_name) AS count FROM ranks
WHERE "order" <> '' AND part_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY "order"
"""
)
def species_per_order(spark, sf):
    seen = S.lines(spark, sf).where(P.is_research()).select("part_id").distinct()
    named = _ranks(spark, sf).where(P.all_filled("order")).join(seen, "part_id", "left_semi")
    return counts.distinct_pairs_per_group(named, "scientific_name", "order").orderBy(F.desc("count"), "order")


@query(
    f"""
WITH {SQL_RANKS}
SELECT "order", count(*) AS n FROM lineitem JOIN ranks ON l_partkey = part_id
WHERE l_returnflag = 'R' AND "order" <> '' GROUP BY "order"
"""
)
def records_per_order(spark, sf):
    research = S.lines(spark, sf).where(P.is_research())
    kept = taxonomy.counts_by_rank(research, _ranks(spark, sf).where(P.all_filled("order")), "order", key="part_id")
    return kept.where(P.all_filled("order")).orderBy(F.desc("n"), "order")


@query(
    """
SELECT p_name AS scientific_name, count(*) AS total FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_returnflag = 'R' GROUP BY p_name ORDER BY total DESC, scientific_name LIMIT 20
"""
)
def top_species(spark, sf):
    research = S.lines(spark, sf).where(P.is_research())
    per_part = counts.count_rows(research, "part_id", "k").join(S.taxa(spark, sf), "part_id")
    return counts.ranked_counts(per_part, "scientific_name", "total", top=20, weight="k")


@query(
    f"""
WITH {SQL_RANKS}
SELECT "order", family, count(*) AS num_obs FROM lineitem JOIN ranks ON l_partkey = part_id
WHERE l_returnflag = 'R' GROUP BY "order", family
"""
)
def taxon_levels(spark, sf):
    research = S.lines(spark, sf).where(P.is_research())
    return taxonomy.counts_by_rank(research, _ranks(spark, sf), ["order", "family"], key="part_id", name="num_obs")


@query(
    f"""
WITH {SQL_RANKS}, k AS (
    SELECT "order", family, scientific_name, count(*) AS n FROM lineitem JOIN ranks ON l_partkey = part_id GROUP BY ALL)
SELECT 1 AS depth, '' AS parents, "order" AS labels, CAST(sum(n) AS BIGINT) AS num_obs FROM k WHERE "order" <> '' GROUP BY "order"
UNION ALL
SELECT 2, "order", family, CAST(sum(n) AS BIGINT) FROM k WHERE "order" <> '' AND family <> '' GROUP BY "order", family
UNION ALL
SELECT 3, "order" || ' - ' || family, scientific_name, CAST(sum(n) AS BIGINT) FROM k
WHERE "order" <> '' AND family <> '' GROUP BY "order", family, scientific_name
"""
)
def taxon_parent_child(spark, sf):
    per_part = counts.count_rows(S.lines(spark, sf), "part_id", "k").join(_ranks(spark, sf), "part_id")
    return taxonomy.parent_child(per_part, ["order", "family", "scientific_name"], path_parents=True, weight="k")


@query(
    f"""
WITH {SQL_RANKS}, k AS (
    SELECT l_linestatus AS park, "order", family, count(*) AS n FROM lineitem JOIN ranks ON l_partkey = part_id GROUP BY ALL)
SELECT park, 1 AS depth, '' AS parents, "order" AS labels, CAST(sum(n) AS BIGINT) AS num_obs FROM k WHERE "order" <> '' GROUP BY park, "order"
UNION ALL
SELECT park, 2, "order", family, CAST(sum(n) AS BIGINT) FROM k WHERE "order" <> '' AND family <> '' GROUP BY park, "order", family
"""
)
def taxon_parent_child_by_park(spark, sf):
    per_part = counts.count_rows(S.lines(spark, sf), ["park", "part_id"], "k").join(_ranks(spark, sf), "part_id")
    return taxonomy.parent_child(per_part, ["order", "family"], path_parents=True, weight="k", by="park")


@query(
    """
SELECT row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS row, o_custkey AS user_id, count(*) AS count FROM orders GROUP BY o_custkey
"""
)
def observer_summary(spark, sf):
    return taxonomy.ranked_summary(S.order_feed(spark, sf), "user_id")


@query(
    """
WITH totals AS (SELECT p_name AS scientific_name, count(*) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name),
entries AS (SELECT CASE WHEN p_size > 20 THEN p_name ELSE p_name || ' sp.' END AS scientific_name, p_brand AS family, p_type AS "order" FROM part
            QUALIFY row_number() OVER (PARTITION BY scientific_name ORDER BY p_brand, p_type) = 1)
SELECT scientific_name, total, family, "order" FROM totals LEFT JOIN entries USING (scientific_name)
"""
)
def taxon_enrich_dedup(spark, sf):
    per_part = counts.count_rows(S.lines(spark, sf), "part_id", "k").join(S.taxa(spark, sf), "part_id")
    totals = counts.count_rows(per_part, "scientific_name", "total", weight="k")
    # names of small parts are spelt otherwise here and find no entry
    name = F.when(F.col("p_size") > 20, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" sp.")))
    entries = S.table(spark, sf, "part").select(
        name.alias("scientific_name"), F.col("p_brand").alias("family"), F.col("p_type").alias("order")
    )
    return taxonomy.enrich_once(totals, entries, ["family", "order"])


@query(
    """
WITH k AS (SELECT p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name),
entries AS (SELECT CASE WHEN p_size > 45 THEN p_name ELSE p_name || ' sp.' END AS p_name, p_type AS "order" FROM part)
SELECT "order", CAST(sum(n) AS BIGINT) AS n FROM k LEFT JOIN entries USING (p_name) GROUP BY "order"
"""
)
def taxon_enrich_fanout(spark, sf):
    per_part = counts.count_rows(S.lines(spark, sf), "part_id", "k").join(S.taxa(spark, sf), "part_id")
    name = F.when(F.col("p_size") > 45, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" sp.")))
    entries = S.table(spark, sf, "part").select(
        name.alias("scientific_name"), F.col("p_type").alias("order")
    )
    return taxonomy.counts_by_rank(per_part.drop("order"), entries, "order", weight="k")


@query(
    """
SELECT l_orderkey AS checklist_id, l_linenumber AS line, l_partkey AS part_id, p_name AS scientific_name,
       CASE WHEN p_size > 25 THEN p_type END AS "order"
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
)
def taxon_enrich_rows(spark, sf):
    # every line keeps its row; names without a taxonomy entry get a missing order
    lines = S.lines(spark, sf).select("checklist_id", "line", "part_id")
    entries = S.table(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"),
        F.col("p_name").alias("scientific_name"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("order"),
    )
    return taxonomy.enrich(lines, entries, "part_id")
