"""Queries: points in polygons, grids, distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.functions.geo import mercator_to_lat, mercator_to_lon
from fieldtally.operators import counts, spatial as G
from fieldtally.plans import standin as S
from fieldtally.plans.registry import query
from fieldtally.sources.inline import inline_rows

def _inside_sql(points: str) -> str:
    """Points (id, x, y, ...) paired with every edge, grouped to one verdict per point and polygon."""
    return f"""{S.SQL_EDGES}, inside AS (
    SELECT p.id, e.poly_id FROM {points} p, edges e GROUP BY p.id, e.poly_id, p.x, p.y HAVING
           count(*) FILTER ((e.y1 > p.y) <> (e.y2 > p.y) AND
               CASE WHEN e.y2 > e.y1 THEN (e.x2 - e.x1) * (p.y - e.y1) - (p.x - e.x1) * (e.y2 - e.y1) > 0
                    ELSE (e.x2 - e.x1) * (p.y - e.y1) - (p.x - e.x1) * (e.y2 - e.y1) < 0 END) % 2 = 1
           OR bool_or(p.x BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND p.y BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)
                      AND (e.x2 - e.x1) * (p.y - e.y1) - (p.x - e.x1) * (e.y2 - e.y1) = 0))"""


def _cover(spark):
    return G.cover_of(G.edges_of(S.rings(spark)))


@query(
    f"""
WITH {S.SQL_LINES}, pts AS (SELECT row_number() OVER () AS id, park, checklist_id, longitude AS x, latitude AS y FROM lines),
{_inside_sql("pts")}
SELECT poly_id, park, count(*) AS n, count(DISTINCT checklist_id) AS checklists, min(x) AS west, max(x) AS east
FROM inside JOIN pts USING (id) GROUP BY poly_id, park
"""
)
def park_points(spark, sf):
    points = S.lines(spark, sf).select("park", "checklist_id", "longitude", "latitude")
    clipped = G.points_in_polygons(points, _cover(spark))
    per_list = clipped.groupBy("poly_id", "park", "checklist_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("longitude").alias("west"), F.max("longitude").alias("east")
    )
    return per_list.groupBy("poly_id", "park").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("checklists"), F.min("west").alias("west"), F.max("east").alias("east")
    )


@query(
    f"""
WITH {S.SQL_LINES}, pts AS (SELECT row_number() OVER () AS id, checklist_id, line, part_id, longitude AS x, latitude AS y FROM lines),
{_inside_sql("pts")}
SELECT checklist_id, line, part_id, x AS longitude, y AS latitude, poly_id FROM inside JOIN pts USING (id) WHERE poly_id = 'north'
"""
)
def one_park_points(spark, sf):
    north = G.select_polygons(S.rings(spark), "poly_id", "north")
    points = S.lines(spark, sf).select("checklist_id", "line", "part_id", "longitude", "latitude")
    return G.points_in_polygons(points, G.cover_of(G.edges_of(north)))


@query("SELECT min(l_extendedprice / 1000.0::DOUBLE) AS xmin, max(l_extendedprice / 1000.0::DOUBLE) AS xmax, min(l_quantity) AS ymin, max(l_quantity) AS ymax FROM lineitem")
def extent(spark, sf):
    return counts.extent(S.lines(spark, sf), "longitude", "latitude")


ROWS, COLS = 20, 38
_PAD = "- 0.01::DOUBLE AS xmin, max(longitude) + 0.005::DOUBLE AS xmax, min(latitude) - 0.004::DOUBLE AS ymin, max(latitude) + 0.008::DOUBLE AS ymax"
SQL_GRID = f"""{S.SQL_LINES}, box AS (SELECT min(longitude) {_PAD} FROM lines),
grid_counts AS (
    SELECT CAST(least(floor((ymax - latitude) * ({ROWS}.0::DOUBLE / (ymax - ymin))), {ROWS - 1}) AS INTEGER) AS "row",
           CAST(least(floor((longitude - xmin) * ({COLS}.0::DOUBLE / (xmax - xmin))), {COLS - 1}) AS INTEGER) AS col, count(*) AS count
    FROM lines, box GROUP BY ALL),
filled AS (
    SELECT CAST(i + 1 AS INTEGER) AS cell, CAST(i // {COLS} AS INTEGER) AS "row", CAST(i % {COLS} AS INTEGER) AS col,
           xmin + (i % {COLS} + 0.5::DOUBLE) * ((xmax - xmin) / {COLS}.0::DOUBLE) AS x,
           ymax - (i // {COLS} + 0.5::DOUBLE) * ((ymax - ymin) / {ROWS}.0::DOUBLE) AS y,
           coalesce(count, 0) AS count, nullif(coalesce(count, 0), 0) AS count2
    FROM generate_series(0, {ROWS * COLS - 1}) AS g(i), box
    LEFT JOIN grid_counts ON grid_counts."row" = i // {COLS} AND grid_counts.col = i % {COLS})"""


def _grid(spark, sf):
    points = S.lines(spark, sf).select("longitude", "latitude")
    grid = G.grid_over(points, ROWS, COLS, pad=(0.01, 0.005, 0.004, 0.008))
    return points, grid


@query(f"WITH {SQL_GRID} SELECT * FROM grid_counts")
def grid_counts(spark, sf):
    points, grid = _grid(spark, sf)
    return G.grid_counts(points, grid)


@query(f"WITH {SQL_GRID} SELECT * FROM filled")
def grid_zero_filled(spark, sf):
    points, grid = _grid(spark, sf)
    return G.zero_filled_grid(G.grid_counts(points, grid), grid)


SQL_GRIDS = f"""{S.SQL_LINES}, boxes AS (
    SELECT park, min(longitude) - 0.01::DOUBLE AS xmin, max(longitude) + 0.02::DOUBLE AS xmax, min(latitude) - 0.03::DOUBLE AS ymin,
           max(latitude) + 0.04::DOUBLE AS ymax, CASE park WHEN 'F' THEN 12 ELSE 9 END AS rows, CASE park WHEN 'F' THEN 20 ELSE 31 END AS cols
    FROM lines GROUP BY park)"""


@query(
    f"""
WITH {SQL_GRIDS}
SELECT park, CAST(least(floor((ymax - latitude) * (rows::DOUBLE / (ymax - ymin))), rows - 1) AS INTEGER) AS "row",
       CAST(least(floor((longitude - xmin) * (cols::DOUBLE / (xmax - xmin))), cols - 1) AS INTEGER) AS col, count(*) AS count
FROM lines JOIN boxes USING (park) GROUP BY ALL
"""
)
def grid_counts_by_park(spark, sf):
    """Cells of both parks, each on its own grid, from one scan for the extents and one for the counts."""
    points = S.lines(spark, sf).select("park", "longitude", "latitude")
    shapes = inline_rows(spark, ["park", "rows", "cols", "left", "right", "bottom", "top"], [(p, r, c, 0.01, 0.02, 0.03, 0.04) for p, r, c in (("F", 12, 20), ("O", 9, 31))])
    return G.grid_counts_by(points, G.grid_table(points, shapes), listed=shapes)


# One square per supplier, one in seven of them in the same place, and points on and around them.
_SQUARES = """squares AS (
    SELECT s_suppkey AS poly_id, CASE WHEN s_suppkey % 7 = 0 THEN 100.0::DOUBLE ELSE (s_suppkey % 37) * 10.0::DOUBLE END AS x,
           CASE WHEN s_suppkey % 7 = 0 THEN 100.0::DOUBLE ELSE (s_suppkey % 41) * 10.0::DOUBLE END AS y,
           (1 + s_nationkey) * 0.5::DOUBLE AS side FROM supplier),
spots AS (
    SELECT l_orderkey, CASE WHEN l_linenumber < 3 THEN 100.0::DOUBLE + (l_partkey % 16) * 0.25::DOUBLE ELSE (l_partkey % 400) * 0.9375::DOUBLE END AS x,
           CASE WHEN l_linenumber < 3 THEN 100.0::DOUBLE + (l_orderkey % 16) * 0.25::DOUBLE ELSE (l_orderkey % 420) * 0.9375::DOUBLE END AS y FROM lineitem)"""


@query(
    f"""
WITH {_SQUARES}, distinct_spots AS (SELECT x, y, count(*) AS k FROM spots GROUP BY x, y)
SELECT poly_id, CAST(sum(k) AS BIGINT) AS n, min(p.x) AS west, max(p.y) AS north
FROM distinct_spots p JOIN squares s ON p.x BETWEEN s.x AND s.x + side AND p.y BETWEEN s.y AND s.y + side GROUP BY poly_id
"""
)
def points_in_square_per_supplier(spark, sf):
    """A layer from a table, of squares of many sizes, some on top of each other; a third of the points is in one cell."""
    sevenths, place = F.col("s_suppkey") % 7 == 0, lambda n: (F.col("s_suppkey") % n) * 10.0
    squares = S.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("poly_id"), F.when(sevenths, 100.0).otherwise(place(37)).alias("x"),
        F.when(sevenths, 100.0).otherwise(place(41)).alias("y"), ((1 + F.col("s_nationkey")) * 0.5).alias("side"),
    )
    corner = F.posexplode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]))
    corners = squares.select("poly_id", "x", "y", "side", corner.alias("seq", "c"))
    rings = corners.select(
        "poly_id", F.lit(1).alias("part"), F.lit(1).alias("ring"), "seq",
        (F.col("x") + F.col("side") * F.col("c.i")).alias("x"), (F.col("y") + F.col("side") * F.col("c.j")).alias("y"),
    )
    near = F.col("l_linenumber") < 3
    spots = S.table(spark, sf, "lineitem").select(
        F.when(near, 100.0 + (F.col("l_partkey") % 16) * 0.25).otherwise((F.col("l_partkey") % 400) * 0.9375).alias("x"),
        F.when(near, 100.0 + (F.col("l_orderkey") % 16) * 0.25).otherwise((F.col("l_orderkey") % 420) * 0.9375).alias("y"),
    )
    places = spots.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"))
    found = G.points_in_polygons(places, G.cover_of(G.edges_of(rings)), "x", "y")
    return found.groupBy("poly_id").agg(F.sum("k").alias("n"), F.min("x").alias("west"), F.max("y").alias("north"))


@query(
    f"""
WITH {SQL_GRID}, centres AS (SELECT cell AS id, x, y FROM filled), {_inside_sql("centres")}
SELECT count(*) AS cells, count(*) FILTER (count > 0) AS occupied,
       count(*) FILTER (count > 0)::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE AS percent
FROM inside JOIN filled ON inside.id = filled.cell
"""
)
def grid_coverage(spark, sf):
    points, grid = _grid(spark, sf)
    cells = G.zero_filled_grid(G.grid_counts(points, grid), grid)
    return G.grid_coverage(cells, _cover(spark))


@query(
    f"""
WITH {SQL_GRID}
SELECT (CASE WHEN count >= 50 THEN 3 WHEN count >= 10 THEN 2 WHEN count >= 1 THEN 1 ELSE 0 END) AS density, count(*) AS cells
FROM filled GROUP BY density
"""
)
def grid_classes(spark, sf):
    points, grid = _grid(spark, sf)
    cells = G.zero_filled_grid(G.grid_counts(points, grid), grid)
    return counts.count_rows(cells.withColumn("density", G.density_class("count", (1, 10, 50))), "density", "cells")


@query(
    f"""
WITH {SQL_GRID}
SELECT CAST(round(2 * 6378137.0::DOUBLE * asin(sqrt(pow(sin(radians(0)), 2) + pow(cos(radians(44.43629::DOUBLE)), 2)
       * pow(sin(radians((xmax - xmin) / {COLS}.0::DOUBLE) / 2), 2))), 3) AS DOUBLE) AS metres FROM box
"""
)
def cell_width_m(spark, sf):
    _, grid = _grid(spark, sf)
    return G.dense_cells(spark, grid).where("cell = 1").select(
        F.round(G.cell_width_m(grid, F.lit(44.43629)), 3).alias("metres")
    )


@query(
    """
SELECT l_orderkey AS checklist_id, l_linenumber AS line, l_partkey AS part_id,
       round(degrees((l_extendedprice - 7600000.0::DOUBLE) / 6378137.0::DOUBLE), 6) AS lon,
       round(degrees(atan(sinh((l_extendedprice + 5500000.0::DOUBLE) / 6378137.0::DOUBLE))), 6) AS lat
FROM lineitem
"""
)
def mercator_to_lonlat(spark, sf):
    return S.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("checklist_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part_id"),
        F.round(mercator_to_lon(F.col("l_extendedprice") - 7600000.0), 6).alias("lon"),
        F.round(mercator_to_lat(F.col("l_extendedprice") + 5500000.0), 6).alias("lat"),
    )


@query(
    f"""
WITH {S.SQL_LINES}, vertices(layer, part, ring, seq, x, y) AS (VALUES {S.sql_values(S.LINE_ROWS)}),
edges AS (SELECT * FROM (SELECT layer, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vertices
          WINDOW w AS (PARTITION BY layer, part, ring ORDER BY seq)) WHERE x2 IS NOT NULL),
nearest AS (
    SELECT park, layer, longitude, latitude, min(sqrt(pow(longitude - (x1 + t * (x2 - x1)), 2) + pow(latitude - (y1 + t * (y2 - y1)), 2))) AS distance
    FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((longitude - x1) * (x2 - x1) + (latitude - y1) * (y2 - y1))
                 / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t
          FROM (SELECT DISTINCT park, longitude, latitude FROM lines), edges) GROUP BY ALL)
SELECT park, layer, count(*) AS n, count(*) FILTER (distance < 5) AS near, round(min(distance), 9) AS closest, round(max(distance), 9) AS farthest
FROM nearest GROUP BY park, layer
"""
)
def nearest_feature(spark, sf):
    points = S.lines(spark, sf).select("park", "longitude", "latitude").distinct()
    edges = G.edges_of(S.line_rings(spark), closed=False, keys=("layer",))
    found = G.nearest_features(points, edges, ["trail", "road"])
    return found.groupBy("park", "layer").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("distance") < 5).alias("near"),
        F.round(F.min("distance"), 9).alias("closest"),
        F.round(F.max("distance"), 9).alias("farthest"),
    )
