"""Queries: the readers' and writers' rules, on lines of text made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.operators import reshape, spatial as G
from fieldtally.operators.columns import normalise_names
from fieldtally.plans import standin as S
from fieldtally.plans.registry import query
from fieldtally.sources import readers, schemas
from fieldtally.sources.writers import csv_format, geojson_lines


def _quoted(column):
    return F.concat(F.lit('"'), F.regexp_replace(column, '"', '""'), F.lit('"'))


def _export_lines(spark, sf):
    """An observation export: quotes and commas in texts, bad dates, missing and unreadable numbers."""
    line, text = F.col("l_linenumber"), lambda c: F.col(c).cast("string")
    cells = {
        "id": (F.col("l_orderkey") * 10 + line).cast("string"),
        "observed_on": F.when(line == 7, "some day").when(line == 6, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")),
        "user_id": text("l_suppkey"),
        "quality_grade": F.when(F.col("l_returnflag") == "R", "research").otherwise("casual"),
        "place_guess": _quoted(F.concat(F.lit('bay "'), F.col("l_linestatus"), F.lit('", east'))),
        "positional_accuracy": F.when(line == 5, "NA").when(line == 4, "about 9").otherwise(text("l_quantity")),
        "scientific_name": F.concat(F.lit("Redgear part"), text("l_partkey")),
        "taxon_species_name": F.when(F.col("l_returnflag") == "A", "").otherwise(F.concat(F.lit("Redgear part"), text("l_partkey"))),
        "latitude": text("l_quantity"),
        "longitude": text("l_extendedprice"),
    }
    values = [cells.get(name, F.lit("")) for name in schemas.OBSERVATION_EXPORT.names]
    lines = S.table(spark, sf, "lineitem").select(F.concat_ws(",", *values).alias("value"))
    return readers.table_of_lines(lines, schemas.OBSERVATION_EXPORT.names)


@query(
    """
SELECT l_orderkey * 10 + l_linenumber AS id,
       CASE WHEN l_linenumber < 6 THEN CAST(l_shipdate AS DATE) END AS observed_on,
       CAST(CASE WHEN l_linenumber < 6 THEN year(l_shipdate) END AS INTEGER) AS year,
       l_suppkey AS user_id, CASE WHEN l_returnflag = 'R' THEN 'research' ELSE 'casual' END AS quality_grade,
       'bay "' || l_linestatus || '", east' AS place_guess,
       CASE WHEN l_linenumber NOT IN (4, 5) THEN l_quantity END AS positional_accuracy,
       'Redgear part' || l_partkey AS full_scientific_name,
       CASE WHEN l_returnflag = 'A' THEN '' ELSE 'Redgear part' || l_partkey END AS scientific_name,
       'Redgear' AS genus,
       l_quantity AS latitude, l_extendedprice AS longitude
FROM lineitem
"""
)
def observation_lines(spark, sf):
    found = readers.canonical_observations(readers.observation_export(_export_lines(spark, sf)))
    return found.select(
        "id", "observed_on", "year", "user_id", "quality_grade", "place_guess", "positional_accuracy", "full_scientific_name",
        "scientific_name", "genus", "latitude", "longitude",
    )


@query("SELECT count(*) AS rows, count(*) FILTER (l_linenumber = 4) AS positional_accuracy, 0::BIGINT AS latitude, 0::BIGINT AS malformed FROM lineitem")
def observation_cells_unparsed(spark, sf):
    """Cells that the typed reader turns into NULL because they are no numbers, and lines with a wrong count of cells."""
    raw = _export_lines(spark, sf)
    return readers.unparsed_cells(raw, schemas.OBSERVATION_EXPORT).select("rows", "positional_accuracy", "latitude", "malformed")


@query(
    """
SELECT 'S' || o_orderkey AS checklist_id, 'obs"' || o_custkey AS observer_id, CAST(o_orderdate AS DATE) AS obs_date,
       CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE '3' END AS count, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS duration_min,
       o_orderpriority AS protocol, CAST(o_orderstatus = 'F' AS INTEGER) AS all_species_reported
FROM orders
"""
)
def checklist_lines(spark, sf):
    """A tab-separated dump, in which quotes are plain text."""
    status = F.col("o_orderstatus")
    cells = {
        "SAMPLING EVENT IDENTIFIER": F.concat(F.lit("S"), F.col("o_orderkey").cast("string")),
        "OBSERVER ID": F.concat(F.lit('obs"'), F.col("o_custkey").cast("string")),
        "OBSERVATION DATE": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "OBSERVATION COUNT": F.when(status == "F", "X").otherwise("3"),
        "DURATION MINUTES": F.when(status == "O", "").otherwise(F.col("o_totalprice").cast("string")),
        "PROTOCOL TYPE": F.col("o_orderpriority"),
        "ALL SPECIES REPORTED": (status == "F").cast("int").cast("string"),
    }
    lines = S.table(spark, sf, "orders").select(
        F.concat_ws("\t", *[cells.get(h, F.lit("")) for h in schemas.CHECKLIST_DUMP]).alias("value")
    )
    header = [h.replace(" ", ".") for h in schemas.CHECKLIST_DUMP]
    found = readers.canonical_checklists(readers.checklist_dump(readers.cells_of_lines(lines, header, "\t")))
    return found.select("checklist_id", "observer_id", "obs_date", "count", "duration_min", "protocol", "all_species_reported")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS site_code, s_name AS site_name, nullif(CAST(s_nationkey AS VARCHAR), '3') AS nation FROM supplier")
def dimension_lines(spark, sf):
    """A small list whose header has blanks, capitals and a byte-order mark; nation 3 is written as missing."""
    nation = F.when(F.col("s_nationkey") == 3, "NA").otherwise(F.col("s_nationkey").cast("string"))
    lines = S.table(spark, sf, "supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), _quoted(F.col("s_name")), nation).alias("value"))
    raw = readers.table_of_lines(lines, ["\ufeffSite Code", " Site Name", "Nation "]).drop("malformed")
    return normalise_names(raw, sep="_")


@query(
    """
SELECT p_name AS scientific_name, p_brand AS common_name,
       'state ' || CASE WHEN p_size > 25 THEN 'endangered' ELSE 'threatened' END AS listing_status
FROM part WHERE p_brand <> 'Brand#11'
"""
)
def status_list_lines(spark, sf):
    status = F.when(F.col("p_size") > 25, "Endangered").otherwise("THREATENED")
    lines = S.table(spark, sf, "part").select(F.concat_ws(",", _quoted(F.col("p_name")), "p_brand", status).alias("value"))
    table = readers.table_of_lines(lines, ["scientific_name", "common_name", "listing_status"])
    return readers.status_list(table, "state", skip_common_names=("Brand#11",))


@query(
    """
SELECT p_name AS scientific_name, nullif(p_brand, 'Brand#22') AS common_name, CASE WHEN p_size > 25 THEN 'invasive' ELSE 'pest' END AS category,
       CASE WHEN p_size % 2 = 0 THEN 'Y' ELSE '' END AS in_park
FROM part
"""
)
def watch_list_lines(spark, sf):
    """A watch list whose presence column has a name of its own; one brand is written as missing."""
    present = F.when(F.col("p_size") % 2 == 0, "Y").otherwise("")
    brand = F.when(F.col("p_brand") == "Brand#22", "NA").otherwise(F.col("p_brand"))
    kind = F.when(F.col("p_size") > 25, "invasive").otherwise("pest")
    lines = S.table(spark, sf, "part").select(F.concat_ws(",", _quoted(F.col("p_name")), brand, kind, present).alias("value"))
    table = readers.table_of_lines(lines, ["Scientific Name", "Common Name", "Category", "North Park"]).drop("malformed")
    return readers.watch_list(table, "north_park")


@query(
    """
SELECT CAST(s_suppkey AS VARCHAR) AS poly_id, count(*) AS edges, 4.0::DOUBLE * (1 + s_nationkey) AS outline
FROM supplier, range(4) GROUP BY s_suppkey, s_nationkey
"""
)
def vertex_lines(spark, sf):
    """A layer with one square per supplier, from lines of vertices to edges."""
    side = 1 + F.col("s_nationkey")
    corner = F.posexplode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]))
    corners = S.table(spark, sf, "supplier").select("s_suppkey", side.alias("side"), corner.alias("seq", "c"))
    cells = ("s_suppkey", F.lit(1), F.lit(1), "seq", F.col("side") * F.col("c.i"), F.col("side") * F.col("c.j"))
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cells]
    lines = corners.select(F.concat_ws(",", *texts).alias("value"))
    edges = G.edges_of(readers.vertices(readers.table_of_lines(lines, schemas.RINGS.names)))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return edges.groupBy("poly_id").agg(F.count(F.lit(1)).alias("edges"), F.sum(length).alias("outline"))


@query(
    """
SELECT l_orderkey AS checklist_id, l_linenumber AS line, CASE WHEN l_linenumber = 1 THEN ' "' || l_returnflag || '", ' ELSE l_returnflag END AS remark,
       CASE WHEN l_linenumber <> 2 THEN l_quantity END AS amount
FROM lineitem
"""
)
def result_csv_lines(spark, sf):
    """Result rows in the writer's format, read back: quotes, commas, blanks at the ends and missing values stay."""
    flag, first = F.col("l_returnflag"), F.col("l_linenumber") == 1
    rows = S.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("checklist_id"),
        F.col("l_linenumber").alias("line"),
        F.when(first, F.concat(F.lit(' "'), flag, F.lit('", '))).otherwise(flag).alias("remark"),
        F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("amount"),
    )
    options = {name: str(value).lower() if isinstance(value, bool) else value for name, value in csv_format().items()}
    lines = rows.select(F.to_csv(F.struct(*rows.columns), options).alias("value"))
    back = readers.table_of_lines(lines, rows.columns)
    return back.select(*[F.col(name).cast(kind).alias(name) for name, kind in rows.dtypes])


@query(
    """
SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || l_extendedprice || ',' || l_quantity || ']},"properties":{"id":'
       || l_orderkey || ',"grade":' || CASE WHEN l_returnflag = 'N' THEN 'null' ELSE '"' || l_returnflag || '"' END || '}}' AS value
FROM lineitem
"""
)
def geojson_points(spark, sf):
    points = S.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.nullif("l_returnflag", F.lit("N")).alias("grade"),
        F.col("l_extendedprice").alias("longitude"),
        F.col("l_quantity").alias("latitude"),
    )
    return geojson_lines(points)


@query(
    """
SELECT park, count(*) AS n, min(observed_on) AS first, max(observed_on) AS last
FROM (SELECT l_linestatus AS park, CAST(l_shipdate AS DATE) AS observed_on FROM lineitem
      UNION ALL SELECT o_orderstatus, CAST(o_orderdate AS DATE) FROM orders) GROUP BY park
"""
)
def strict_stack_totals(spark, sf):
    """Both feeds in the same columns, in another order, one under the other."""
    lines = S.lines(spark, sf).select("park", F.col("obs_date").alias("observed_on"))
    both = reshape.stack_strict(lines, S.order_feed(spark, sf).select("observed_on", "park"))
    return both.groupBy("park").agg(F.count(F.lit(1)).alias("n"), F.min("observed_on").alias("first"), F.max("observed_on").alias("last"))
