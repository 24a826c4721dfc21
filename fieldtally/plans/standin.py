"""The shared test tables in the roles of the two feeds.

A line item is a line of a checklist, its order the checklist, the customer the observer, the part
the taxon. Every function joins only the tables whose columns a query asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.operators.predicates import MIN_DURATION
from fieldtally.sources.inline import inline_rows
from fieldtally.types import ColumnLike

# Words of the order priority in the role of a protocol.
TRAVELING, STATIONARY, INCIDENTAL = "1-URGENT", "2-HIGH", "5-LOW"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checklist lines without anything that needs a join."""
    flag = F.col("l_returnflag")
    grade = F.when(flag == "R", "research").when(flag == "N", "needs_id").otherwise("casual")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("park"),
        F.col("l_orderkey").alias("checklist_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("site_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").cast("date").alias("obs_date"),
        F.col("l_quantity").alias("duration_min"),
        grade.alias("quality_grade"),
        F.when(flag == "A", "spuh").otherwise("species").alias("category"),
        (F.col("l_extendedprice") / 1000.0).alias("longitude"),
        F.col("l_quantity").alias("latitude"),
        F.when(F.col("l_linenumber") == 7, "X")
        .when(F.col("l_linenumber") == 6, "")
        .otherwise(F.col("l_quantity").cast("int").cast("string"))
        .alias("count_text"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per checklist."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("checklist_id"),
        F.col("o_custkey").alias("observer_id"),
        F.col("o_orderpriority").alias("protocol"),
        (F.col("o_orderstatus") == "F").cast("int").alias("all_species_reported"),
    )


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: the taxon's name and two ranks."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"),
        F.col("p_name").alias("scientific_name"),
        F.col("p_type").alias("order"),
        F.col("p_brand").alias("family"),
    )


ROWS_PER_TASK = 250_000  # lines and headers of one task of their join and of the counts behind it


def reduced_lines_with_headers(spark: SparkSession, sf_dir: str, *keys: ColumnLike, threshold: float = MIN_DURATION) -> DataFrame:
    """Line counts ``k`` per checklist and ``keys``, with the header joined on.

    For queries that group by checklist again: lines are counted before the join, so a checklist
    with very many lines travels as two or three counts per key: of lines that lasted ``threshold``, of shorter ones and of
    lines without a duration. ``duration_min`` is the shortest of those counted together, so it tells the side of ``threshold``.

    The join is dealt by checklist over as many tasks as the tables' row counts ask for, so that a task's memory does not
    grow with them: adaptive execution would merge tasks by their compressed bytes, a twentieth of what they sort and count.
    Where the cores alone make that many tasks, the dealing is left to it.
    """
    feed, heads = lines(spark, sf_dir), headers(spark, sf_dir)
    lasted = (F.col("duration_min") >= threshold).alias("_lasted")
    counted = feed.groupBy("checklist_id", lasted, *keys).agg(
        F.min("duration_min").alias("duration_min"), F.count(F.lit(1)).alias("k")
    ).drop("_lasted")
    tasks = 1 + (feed.count() + heads.count()) // ROWS_PER_TASK
    if tasks <= spark.sparkContext.defaultParallelism:
        return counted.join(heads, "checklist_id")
    return counted.repartition(tasks, "checklist_id").join(heads.repartition(tasks, "checklist_id"), "checklist_id")


def lines_with_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).join(taxa(spark, sf_dir), "part_id")


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a second feed: one record per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("park"),
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("date").alias("observed_on"),
        F.col("o_totalprice").alias("positional_accuracy"),
        F.col("o_orderpriority").alias("place_guess"),
    )


WATCH_ROWS = (
    ("red widget", "Red widget", "species of interest", "Y"),
    ("old rod", "Old rod", "species of interest", "N"),
    ("ghost orchid", "Ghost orchid", "species of interest", "Y"),
    ("hot plate", "Hot plate", "invasive established", "Y"),
    ("small gizmo", "Small gizmo", "invasive not established", "N"),
    ("cold ring", "Cold ring", "pest disease", "U"),
    ("blue bolt", "Blue bolt", "pest disease", "Y"),
    ("blue spp.", "Any blue", "invasive established", "Y"),
    ("new spp.", "Any new", "species of interest", "N"),
)
STATUS_ROWS = (
    ("red gear", "federally endangered"),
    ("old bolt", "federally threatened"),
    ("red gear", "state endangered"),
    ("hot rod", "state threatened"),
)
# A concave park, a park with a hole, and one that overlaps the first.
RING_ROWS = tuple(
    (poly, 1, ring, i + 1, float(x), float(y))
    for poly, ring, vertices in (
        ("north", 1, ((10, 10), (60, 10), (60, 45), (35, 20), (10, 45))),
        ("ring", 1, ((65, 5), (100, 5), (100, 45), (65, 45))),
        ("ring", 2, ((75, 15), (90, 15), (90, 35), (75, 35))),
        ("centre", 1, ((40.5, 8.5), (72.25, 25), (40.5, 41.5))),
    )
    for i, (x, y) in enumerate(vertices)
)
# Two line layers.
LINE_ROWS = tuple(
    (layer, part, 1, i + 1, float(x), float(y))
    for layer, part, vertices in (
        ("trail", 1, ((5, 5), (30, 20), (55, 8))),
        ("trail", 2, ((80, 40), (95, 30), (95, 12))),
        ("road", 1, ((1, 48), (104, 2))),
    )
    for i, (x, y) in enumerate(vertices)
)


def watch_list(spark: SparkSession) -> DataFrame:
    return inline_rows(spark, ["scientific_name", "common_name", "category", "in_park"], WATCH_ROWS)


def status_list(spark: SparkSession) -> DataFrame:
    return inline_rows(spark, ["scientific_name", "listing_status"], STATUS_ROWS)


def rings(spark: SparkSession) -> DataFrame:
    return inline_rows(spark, ["poly_id", "part", "ring", "seq", "x", "y"], RING_ROWS)


def line_rings(spark: SparkSession) -> DataFrame:
    return inline_rows(spark, ["layer", "part", "ring", "seq", "x", "y"], LINE_ROWS)


def sql_values(rows) -> str:
    """The same literal rows for the oracle SQL."""
    def text(value):
        return "'" + value + "'" if isinstance(value, str) else ("CAST(%r AS DOUBLE)" % value if isinstance(value, float) else repr(value))

    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


# Shared CTEs of the oracle SQL, in the same roles.
SQL_LINES = """lines AS (
    SELECT l_linestatus AS park, l_orderkey AS checklist_id, l_partkey AS part_id, l_suppkey AS site_id,
           l_linenumber AS line, CAST(l_shipdate AS DATE) AS obs_date, l_quantity AS duration_min,
           CASE l_returnflag WHEN 'R' THEN 'research' WHEN 'N' THEN 'needs_id' ELSE 'casual' END AS quality_grade,
           CASE l_returnflag WHEN 'A' THEN 'spuh' ELSE 'species' END AS category,
           l_extendedprice / 1000.0::DOUBLE AS longitude, l_quantity AS latitude,
           CASE l_linenumber WHEN 7 THEN 'X' WHEN 6 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS count_text
    FROM lineitem)"""
SQL_HEADERS = """headers AS (
    SELECT o_orderkey AS checklist_id, o_custkey AS observer_id, o_orderpriority AS protocol,
           CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS all_species_reported
    FROM orders)"""
SQL_TAXA = """taxa AS (
    SELECT p_partkey AS part_id, p_name AS scientific_name, p_type AS "order", p_brand AS family FROM part)"""
SQL_FULL = f"""{SQL_LINES}, {SQL_HEADERS}, {SQL_TAXA}, full_lines AS (
    SELECT * FROM lines JOIN headers USING (checklist_id) JOIN taxa USING (part_id))"""
SQL_WATCH = f"""watch(scientific_name, common_name, category, in_park) AS (VALUES {sql_values(WATCH_ROWS)})"""
SQL_STATUS = f"""status(scientific_name, listing_status) AS (VALUES {sql_values(STATUS_ROWS)})"""
SQL_EDGES = f"""ring_vertices(poly_id, part, ring, seq, x, y) AS (VALUES {sql_values(RING_ROWS)}),
edges AS (
    SELECT poly_id, x AS x1, y AS y1,
           coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
    FROM ring_vertices WINDOW w AS (PARTITION BY poly_id, part, ring ORDER BY seq))"""
