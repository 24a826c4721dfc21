"""Polygons, grids and distances against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldtally.functions.geo import inside_edges
from fieldtally.operators import spatial as G
from fieldtally.sources import inline_rows

RING = ["poly_id", "part", "ring", "seq", "x", "y"]
SHAPES = {
    "square": [[(0, 0), (4, 0), (4, 4), (0, 4)]],
    "concave": [[(10, 0), (20, 0), (20, 9), (15, 2), (10, 9)]],
    "holed": [[(30, 0), (40, 0), (40, 10), (30, 10)], [(33, 3), (37, 3), (37, 7), (33, 7)]],
    "overlap": [[(2, 2), (6, 2), (6, 6), (2, 6)]],
    "parts": [[(50, 0), (52, 0), (51, 2)], [(54, 0), (56, 0), (55, 2)]],
}


def rings_of(shapes):
    return [
        (name, i, 1, k, float(x), float(y)) for name, rings in shapes.items() for i, ring in enumerate(rings) for k, (x, y) in enumerate(ring)
    ]


def on_segment(px, py, a, b):
    side = (b[0] - a[0]) * (py - a[1]) - (px - a[0]) * (b[1] - a[1])
    return side == 0 and min(a[0], b[0]) <= px <= max(a[0], b[0]) and min(a[1], b[1]) <= py <= max(a[1], b[1])


def brute_inside(px, py, rings):
    odd = False
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1]):
            if on_segment(px, py, a, b):
                return True
            if (a[1] > py) != (b[1] > py) and px < a[0] + (py - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                odd = not odd
    return odd


def sample_points():
    rng = random.Random(5)
    points = [(rng.uniform(-3, 60), rng.uniform(-3, 12)) for _ in range(1500)]
    # corners, edges, horizontal edges, and quarter-grid points
    points += [(0.0, 0.0), (4.0, 2.0), (2.0, 0.0), (15.0, 2.0), (33.0, 5.0), (35.0, 3.0), (6.0, 6.0), (51.0, 0.0), (40.0, 10.0)]
    points += [(x / 4, y / 4) for x in range(-4, 30) for y in range(-4, 30)]
    return points


@pytest.mark.parametrize("most", [2, 12])
def test_points_in_polygons_equals_brute_force(spark, most):
    points = sample_points()
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "id int, longitude double, latitude double")
    edges = G.edges_of(inline_rows(spark, RING, rings_of(SHAPES)))
    found = {(r["id"], r["poly_id"]) for r in G.points_in_polygons(df, G.cover_of(edges, most=most)).collect()}
    want = {(i, name) for i, (x, y) in enumerate(points) for name, rings in SHAPES.items() if brute_inside(x, y, rings)}
    assert found == want
    assert {(i, n) for i, n in want if points[i] == (3.0, 3.0)} and len([1 for i, n in want if points[i] == (3.0, 3.0)]) == 2


def test_ring_direction_and_start_do_not_matter(spark):
    points = sample_points()[:600]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "id int, longitude double, latitude double")
    turned = {n: [list(reversed(ring[2:] + ring[:2])) for ring in rings] for n, rings in SHAPES.items()}
    results = []
    for shapes in (SHAPES, turned):
        edges = G.edges_of(inline_rows(spark, RING, rings_of(shapes)))
        results.append({(r["id"], r["poly_id"]) for r in G.points_in_polygons(df, G.cover_of(edges)).collect()})
    assert results[0] == results[1]


def test_interior_cells_need_no_edges(spark):
    edges = G.edges_of(inline_rows(spark, RING, rings_of({"square": SHAPES["square"]})))
    cover = G.cover_of(edges, most=2)
    interior = cover.cells.where(F.col("_edges").isNull())
    covered = interior.selectExpr("sum(pow(16, -_level))").first()[0] * cover.side**2
    assert 4.0 < covered <= 16.0 and cover.cells.agg(F.max(F.size("_edges"))).first()[0] <= 2


def test_long_outlines_have_short_lists(spark):
    """A star of 100,000 vertices and a small square far off: no list grows with the outline, each has its own resolution."""
    n = 100_000
    k = spark.range(n).select(F.lit("star").alias("poly_id"), F.lit(1).alias("part"), F.lit(1).alias("ring"), F.col("id").alias("seq"), "id")
    angle = F.col("id") * (2 * math.pi / n)
    radius = 10.0 + 2.0 * F.sin(angle * 7) + (F.col("id") % 2) * 0.001
    star = k.select("poly_id", "part", "ring", "seq", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))
    small = inline_rows(spark, RING, rings_of({"small": [[(500, 500), (500.5, 500), (500.5, 500.5), (500, 500.5)]]}))
    cover = G.cover_of(G.edges_of(star.unionByName(small)), most=20)
    assert cover.cells.agg(F.max(F.size("_edges"))).first()[0] <= 20 and len(cover.levels) > 2
    rng = random.Random(8)
    points = [(rng.uniform(-13, 13), rng.uniform(-13, 13)) for _ in range(4000)] + [(500.25, 500.25), (500.0, 500.1), (499.9, 500.1)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "id int, longitude double, latitude double")
    found = {(r["id"], r["poly_id"]) for r in G.points_in_polygons(df, cover).collect()}
    want, close = set(), set()
    for i, (x, y) in enumerate(points[:4000]):
        a = math.atan2(y, x) % (2 * math.pi)
        edge = 10.0 + 2.0 * math.sin(a * 7)
        if abs(math.hypot(x, y) - edge) < 0.01:
            close.add(i)
        elif math.hypot(x, y) < edge:
            want.add((i, "star"))
    assert {f for f in found if f[0] not in close} == want | {(4000, "small"), (4001, "small")}


def test_missing_coordinates_drop(spark):
    df = inline_rows(spark, ["longitude", "latitude"], [(1.0, 1.0), (None, 1.0), (1.0, None)])
    df = df.union(spark.sql("SELECT double('NaN'), 1D"))
    edges = G.edges_of(inline_rows(spark, RING, rings_of(SHAPES)))
    assert G.points_in_polygons(df, G.cover_of(edges)).count() == 1


def test_closing_vertex_is_harmless(spark):
    ring = [(0, 0), (4, 0), (4, 4), (0, 4)]
    open_ring = G.edges_of(inline_rows(spark, RING, rings_of({"a": [ring]})))
    closed_ring = G.edges_of(inline_rows(spark, RING, rings_of({"a": [ring + ring[:1]]})))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(open_ring) == key(closed_ring) and open_ring.count() == 4
    assert G.edges_of(inline_rows(spark, RING, rings_of({"a": [ring]})), closed=False).count() == 3


def test_unknown_polygon_is_an_error(spark):
    layer = inline_rows(spark, RING, rings_of(SHAPES))
    assert G.select_polygons(layer, "poly_id", ["square", "holed"]).count() == 12
    with pytest.raises(ValueError, match="nowhere"):
        G.select_polygons(layer, "poly_id", ["square", "nowhere"])


def test_inside_edges_alone(spark):
    edges = G.edges_of(inline_rows(spark, RING, rings_of({"square": SHAPES["square"]})))
    listed = edges.groupBy("poly_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("e"))
    tests = [(2.0, 2.0, True), (4.0, 4.0, True), (5.0, 4.0, False), (0.0, 1.0, True), (-1.0, 0.0, False)]
    for x, y, want in tests:
        assert listed.select(inside_edges(F.lit(x), F.lit(y), "e")).first()[0] is want


GRID_POINTS = [(0.0, 10.0), (10.0, 0.0), (10.0, 10.0), (0.0, 0.0), (5.0, 5.0), (2.5, 9.9), (10.1, 5.0), (5.0, -0.1)]


def test_grid_borders(spark, rows):
    grid = G.Grid(0.0, 10.0, 0.0, 10.0, rows=2, cols=4)
    df = inline_rows(spark, ["longitude", "latitude"], GRID_POINTS)
    placed = df.select("longitude", "latitude", grid.row_of("latitude").alias("r"), grid.column_of("longitude").alias("c"))
    got = {(x, y): (r, c) for x, y, r, c in rows(placed)}
    assert got[(0.0, 10.0)] == (0, 0)
    assert got[(10.0, 0.0)] == (1, 3)
    assert got[(10.0, 10.0)] == (0, 3)
    assert got[(0.0, 0.0)] == (1, 0)
    # interior lines belong to the cell on the right and below
    assert got[(5.0, 5.0)] == (1, 2)
    assert got[(2.5, 9.9)] == (0, 1)
    assert got[(10.1, 5.0)][1] is None and got[(5.0, -0.1)][0] is None


def test_grid_counts_sum_to_the_points_inside(spark):
    grid = G.Grid(0.0, 10.0, 0.0, 10.0, rows=2, cols=4)
    df = inline_rows(spark, ["longitude", "latitude"], GRID_POINTS)
    cells = G.zero_filled_grid(G.grid_counts(df, grid), grid)
    assert cells.count() == 8
    assert cells.agg(F.sum("count")).first()[0] == 6
    assert cells.where(F.col("count2").isNull()).count() == cells.where("count = 0").count()
    first = cells.orderBy("cell").first()
    assert (first["cell"], first["row"], first["col"], first["x"], first["y"]) == (1, 0, 0, 1.25, 7.5)


def test_grid_over_the_points(spark):
    df = inline_rows(spark, ["longitude", "latitude"], [(0.0, 0.0), (10.0, 20.0)])
    grid = G.grid_over(df, 10, 10, pad=(1.0, 2.0, 3.0, 4.0))
    row = spark.range(1).select(grid.cell_width.alias("w"), grid.cell_height.alias("h")).first()
    assert (row["w"], row["h"]) == (1.3, 2.7)
    assert G.grid_counts(df, grid).count() == 2


def test_coverage(spark):
    grid = G.Grid(0.0, 8.0, 0.0, 8.0, rows=8, cols=8)
    df = inline_rows(spark, ["longitude", "latitude"], [(0.5, 0.5), (0.6, 0.6), (3.5, 3.5), (7.5, 7.5)])
    cells = G.zero_filled_grid(G.grid_counts(df, grid), grid)
    cover = G.cover_of(G.edges_of(inline_rows(spark, RING, rings_of({"square": SHAPES["square"]}))))
    row = G.grid_coverage(cells, cover).first()
    assert (row["cells"], row["occupied"], row["percent"]) == (16, 2, 12.5)
    per_polygon = G.grid_coverage(cells, cover, by_polygon=True).first()
    assert per_polygon["poly_id"] == "square" and per_polygon["percent"] == 12.5


def test_density_classes(spark, rows):
    df = inline_rows(spark, ["n"], [(0,), (1,), (99,), (100,), (40000,)])
    assert rows(df.select("n", G.density_class("n").alias("k"))) == [(0, 0), (1, 1), (99, 1), (100, 2), (40000, 9)]


def test_cell_width(spark):
    grid = G.Grid(-69.0, -68.0, 44.0, 45.0, rows=10, cols=10)
    metres = spark.range(1).select(G.cell_width_m(grid, F.lit(44.0))).first()[0]
    assert metres == pytest.approx(math.radians(0.1) * 6378137 * math.cos(math.radians(44.0)), rel=1e-6)


def segment_distance(px, py, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    length2 = dx * dx + dy * dy
    t = 0.0 if length2 == 0 else max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / length2))
    return math.hypot(px - (a[0] + t * dx), py - (a[1] + t * dy))


@pytest.mark.parametrize("most", [2, 12])
def test_nearest_features_equals_brute_force(spark, most):
    rng = random.Random(11)
    lines = {"trail": [[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(5)] for _ in range(4)], "road": [[(0, 20), (40, 20)]]}
    table = [(layer, i, 1, k, float(x), float(y)) for layer, parts in lines.items() for i, part in enumerate(parts) for k, (x, y) in enumerate(part)]
    edges = G.edges_of(inline_rows(spark, ["layer", *RING[1:]], table), closed=False, keys=("layer",))
    points = [(rng.uniform(-5, 45), rng.uniform(-5, 25)) for _ in range(200)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "id int, longitude double, latitude double")
    twice = df.union(df.where("id < 100"))
    found = G.nearest_features(twice, edges, ["trail", "road"], most=most).collect()
    assert len(found) == 600
    for r in found:
        x, y = points[r["id"]]
        want = min(segment_distance(x, y, a, b) for part in lines[r["layer"]] for a, b in zip(part, part[1:]))
        assert r["distance"] == pytest.approx(want, abs=1e-9)


def test_lists_of_nearest_lines_stay_short(spark):
    """1,000 short lines: cells that hold points are cut until few lines are left, others are not."""
    k = spark.range(1000).select(F.lit("trail").alias("layer"), (F.col("id") % 40).alias("i"), F.floor(F.col("id") / 40).alias("j"))
    x, y = F.col("i") * 0.02, F.col("j") * 0.02
    edges = k.select("layer", x.alias("x1"), y.alias("y1"), (x + 0.004).alias("x2"), (y + 0.003).alias("y2"))
    points = spark.range(4000).select((F.col("id") % 100 * 0.008).alias("longitude"), (F.floor(F.col("id") / 100) * 0.0125).alias("latitude"))
    crowd = G.crowds(points, -1.0, -1.0, 10.0)
    lists = G.nearest_lists(edges, crowd, -1.0, -1.0, 10.0, most=12, least=0)
    full = crowd.selectExpr("int(floor(_px / 4)) _cx", "int(floor(_py / 4)) _cy").distinct()
    sizes = lists.where("_level = 5").join(full, ["_cx", "_cy"]).groupBy("layer", "_cx", "_cy").count()
    assert 0 < sizes.agg(F.max("count")).first()[0] <= 12 and lists.select("_level").distinct().count() > 2


def test_nearest_features_without_coordinates_or_lines(spark):
    edges = inline_rows(spark, ["layer", "x1", "y1", "x2", "y2"], [("trail", 0.0, 0.0, 1.0, 1.0)])
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0)], "id int, longitude double, latitude double")
    found = {(r["id"], r["layer"]): r["distance"] for r in G.nearest_features(df, edges, ["trail", "road"]).collect()}
    assert found == {(1, "trail"): 2.0, (1, "road"): None, (2, "trail"): None, (2, "road"): None, (3, "trail"): None, (3, "road"): None}
    assert G.nearest_features(df.where("id = 9"), edges, ["trail"]).count() == 0


def test_line_layer_clip(spark):
    edges = inline_rows(spark, ["x1", "y1", "x2", "y2"], [(0.0, 0.0, 1.0, 1.0), (5.0, 5.0, 9.0, 9.0), (-5.0, 0.5, 20.0, 0.5)])
    assert G.clip_edges(edges, 0.0, 2.0, 0.0, 2.0).count() == 2


def test_projected_layer_to_degrees(spark):
    ring = [(0.0, 0.0), (20037508.342789244, 0.0), (0.0, 20037508.342789244)]
    layer = inline_rows(spark, RING, rings_of({"a": [ring]}))
    found = {(round(r["x"], 6), round(r["y"], 6)) for r in G.mercator_rings_to_lonlat(layer).collect()}
    assert found == {(0.0, 0.0), (180.0, 0.0), (0.0, 85.051129)}


def test_points_are_not_shuffled_to_their_park_before_they_are_counted(spark, rows):
    points = spark.sql("SELECT element_at(array('a', 'b', 'c'), cast(id % 3 AS int) + 1) AS park, (id % 89) * 1D AS longitude, (id % 53) * 1D AS latitude FROM range(3000)")
    shapes = inline_rows(spark, ["park", "rows", "cols"], [("a", 3, 4), ("b", 5, 2)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # Spark does not know how few grids there are
    try:
        grids = G.grid_table(points, shapes)
        stored = G.grid_counts_by(points, grids.localCheckpoint())
        plan = stored._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        listed = G.grid_counts_by(points, grids, listed=shapes)
        assert "BroadcastHashJoin" in listed._jdf.queryExecution().executedPlan().toString()
        assert rows(stored, "park", "row", "col", "count") == rows(listed, "park", "row", "col", "count")
        assert rows(listed.groupBy("park").agg(F.count("count").alias("cells"), F.sum("count").alias("n"))) == [("a", 12, 1000), ("b", 10, 1000)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
