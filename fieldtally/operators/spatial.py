"""Polygons, grids and points in them, on tables.

A polygon layer is turned into a *cover*: quadtree cells, each with the edges inside it and one point of which it is known
whether it is inside. Points join the cover on their cell, an ordinary equi-join, and test a short edge list. There is no
nested loop and no pair of all points with all polygons.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtally.functions.geo import (
    edge_meets_box,
    haversine_m,
    inside_from_anchor,
    mercator_to_lat,
    mercator_to_lon,
    nearest_edge_distance,
    path_crosses,
)
from fieldtally.functions.values import null_if_zero, percent
from fieldtally.lineage import cut_lineage
from fieldtally.operators.counts import extent
from fieldtally.operators.predicates import edge_in_box
from fieldtally.types import ColumnLike, col_of, names_of, require_columns



# ---------------------------------------------------------------------------------------- layers


def mercator_rings_to_lonlat(rings: DataFrame) -> DataFrame:
    """Vertex table in Web-Mercator metres -> degrees."""
    return rings.withColumns({"x": mercator_to_lon("x"), "y": mercator_to_lat("y")})


def select_polygons(layer: DataFrame, column: str, names: str | Sequence[str]) -> DataFrame:
    """Polygons with the given names; a name that is not in the layer is an error, not an empty result."""
    wanted = names_of(names)
    chosen = layer.where(F.col(column).isin(*wanted))
    found = {row[0] for row in chosen.select(column).distinct().limit(len(wanted) + 1).collect()}
    missing = [name for name in wanted if name not in found]
    if missing:
        raise ValueError(f"no polygon named {missing} in column {column}")
    return chosen


def edges_of(rings: DataFrame, closed: bool = True, keys: Sequence[str] = ("poly_id",)) -> DataFrame:
    """Vertex table -> one row per edge (``x1, y1, x2, y2``) under the layer's keys.

    ``closed`` joins the last vertex of a ring to its first; lines are left open. Edges of length 0
    are dropped. The window runs inside one ring.
    """
    require_columns(rings.columns, [*keys, "part", "ring", "seq", "x", "y"], "vertex table")
    ring = Window.partitionBy(*keys, "part", "ring").orderBy("seq")
    start = ring.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def following(axis: str) -> Column:
        after = F.lead(axis).over(ring)
        return F.coalesce(after, F.first(axis).over(start)) if closed else after

    edges = rings.select(
        *keys,
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        following("x").alias("x2"),
        following("y").alias("y2"),
    ).where(F.col("x2").isNotNull())
    return edges.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def clip_edges(edges: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Line layer reduced to the segments whose box overlaps a window."""
    edge = F.struct("x1", "y1", "x2", "y2")
    return edges.where(edge_in_box(edge, xmin, xmax, ymin, ymax))


_CUT = 4  # a cell is cut into this many by this many
_LEVELS = 20  # the least cell is the layer's width by 4 to this power
_DEEPER = 7  # how often a polygon's cells may be cut, so that edges on top of each other end it
_POINT_LEVELS = 6  # the same for cells around points
_SMALL = 200_000  # rows and edges (some 40 bytes each) of a cover or of lists that are sent to all tasks; larger ones are shuffled
_OFF = 0.5 + 1.0 / 97.0  # place of a cell's anchor in the cell, off the round numbers that vertices are likely to have


@dataclass(frozen=True)
class Cover:
    """Quadtree cells a polygon layer reaches: ``keys, _level, _cx, _cy, _inside, _edges``.

    The root is the square at (``left``, ``bottom``); a cell of level n is its side / 4^n wide. ``_edges`` is NULL for a cell that
    lies inside its polygon as a whole; else it holds the edges that come into the cell, and ``_inside`` tells about its anchor.
    """

    cells: DataFrame
    keys: tuple[str, ...]
    left: float
    bottom: float
    side: float
    levels: tuple[int, ...]
    small: bool

    def joinable(self) -> DataFrame:
        return F.broadcast(self.cells) if self.small else self.cells


def _size_at(side: float, level: Column) -> Column:
    return F.lit(side) / F.pow(F.lit(float(_CUT)), level)


def _anchor(low: float, cell: Column, size: Column) -> Column:
    return F.lit(low) + (cell + F.lit(_OFF)) * size


def cover_of(edges: DataFrame, keys: Sequence[str] = ("poly_id",), most: int = 12) -> Cover:
    """Cover of a polygon layer by a linear quadtree, each polygon at its own resolution.

    A polygon starts with cells about a quarter of its box wide, which are cut once more. Every cell knows of one point, its anchor, whether it is
    inside: a point of the cell is tested by the edges that the path to the anchor crosses, all of which come into the cell. A
    cell with more than ``most`` edges is cut in 4 x 4, and the anchors of the parts follow from its own; the layer's box and the
    levels in use are fetched. Edges are rows until their cell is small enough, so no list is longer than ``most``, but where
    more edges meet in one point or run on top of each other: there cutting ends after seven times. Cells without edges are
    inside and need no test, or drop out.
    """
    keys = tuple(keys)
    edge = F.struct("x1", "y1", "x2", "y2")
    plain = edges.select(*keys, edge.alias("edge"))
    e = F.col("edge")
    box = {
        "_w": F.min(F.least(e["x1"], e["x2"])), "_e": F.max(F.greatest(e["x1"], e["x2"])),
        "_s": F.min(F.least(e["y1"], e["y2"])), "_n": F.max(F.greatest(e["y1"], e["y2"])),
    }
    west, east, south, north = plain.agg(*box.values()).first()
    if west is None:
        west = east = south = north = 0.0
    side = (max(east - west, north - south) or 1.0) * 1.01
    left, bottom = west - side * 0.004, south - side * 0.004
    margin = F.lit(1e-12 * (abs(left) + abs(bottom) + side))

    def cells_between(low: str, high: str, origin: float, size: Column) -> Column:
        return F.sequence(F.floor((F.col(low) - origin) / size).cast("int"), F.floor((F.col(high) - origin) / size).cast("int"))

    def counted(rows: DataFrame) -> DataFrame:
        """Edges of a cell that come into it, with its anchor's side and its number of edges, from all edges that told the side."""
        cell = [*keys, "_level", "_cx", "_cy"]
        size = _size_at(side, F.col("_level"))
        near = edge_meets_box(F.col("edge"), left + F.col("_cx") * size, bottom + F.col("_cy") * size, size, margin)
        told = rows.withColumn("_near", near)
        sums = told.groupBy(*cell).agg(
            (F.first("_from").cast("int") + F.sum(F.col("_flip").cast("int"))).alias("_sides"), F.count_if("_near").alias("_n")
        )
        sums = sums.withColumn("_inside", F.col("_sides") % 2 == 1).drop("_sides")
        named = sums.withColumnsRenamed({c: f"_of_{c}" for c in cell})
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cell]
        found = named.join(told.where("_near").select(*cell, "edge"), reduce(and_, same), "left")
        whole = found.select(*[F.col(f"_of_{c}").alias(c) for c in cell], "_inside", "_n", "edge")
        return cut_lineage(whole.where(F.col("_inside") | (F.col("_n") > 0)))

    boxes = plain.groupBy(*keys).agg(*(c.alias(n) for n, c in box.items()))
    span = F.greatest(F.col("_e") - F.col("_w"), F.col("_n") - F.col("_s"))
    level = F.when(span > 0, F.ceil(F.log(F.lit(side) / span) / math.log(_CUT))).otherwise(_LEVELS)
    boxes = boxes.withColumn("_level", F.least(F.greatest(level, F.lit(0)), F.lit(_LEVELS)).cast("int"))
    size = _size_at(side, F.col("_level"))
    boxes = boxes.withColumn("_cx", F.explode(cells_between("_w", "_e", left, size)))
    boxes = boxes.withColumn("_cy", F.explode(cells_between("_s", "_n", bottom, size))).drop(*box)
    named = boxes.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    start = plain.join(named, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]))
    x, y = _anchor(left, F.col("_cx"), size), _anchor(bottom, F.col("_cy"), size)
    # from outside the layer, left of it, to the anchor
    start = start.withColumns({"_from": F.lit(False), "_flip": path_crosses(F.col("edge"), F.lit(left - side), y, x, y)})
    found = counted(start.drop(*[f"_of_{c}" for c in keys]))
    leaves = []
    for depth in range(_DEEPER + 1):
        # the first cut is for all: it leaves most of a polygon to cells without edges
        dense = (F.col("_n") > (most if depth else 0)) & (F.col("_level") < _LEVELS) & F.lit(depth < _DEEPER)
        leaves.append(found.where(~dense))
        parts = found.where(dense)
        if parts.isEmpty():
            break
        size, half = _size_at(side, F.col("_level")), _size_at(side, F.col("_level") + 1)
        x, y = _anchor(left, F.col("_cx"), size), _anchor(bottom, F.col("_cy"), size)
        steps = F.array(*[F.lit(i) for i in range(_CUT)])
        parts = parts.withColumns({"_x": x, "_y": y}).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
        parts = parts.withColumns({"_cx": F.col("_cx") * _CUT + F.col("_i"), "_cy": F.col("_cy") * _CUT + F.col("_j")})
        to_x, to_y = _anchor(left, F.col("_cx"), half), _anchor(bottom, F.col("_cy"), half)
        parts = parts.withColumns({"_flip": path_crosses(F.col("edge"), F.col("_x"), F.col("_y"), to_x, to_y), "_from": F.col("_inside")})
        found = counted(parts.withColumn("_level", F.col("_level") + 1).select(*keys, "edge", "_level", "_cx", "_cy", "_from", "_flip"))
    rows = reduce(DataFrame.unionByName, leaves)
    cells = rows.groupBy(*keys, "_level", "_cx", "_cy").agg(F.first("_inside").alias("_inside"), F.collect_list("edge").alias("_edges"))
    cells = cut_lineage(cells.withColumn("_edges", F.when(F.size("_edges") > 0, F.col("_edges"))))
    sizes = cells.groupBy("_level").agg(F.sum(F.lit(1) + F.coalesce(F.size("_edges"), F.lit(0)))).collect()
    return Cover(cells, keys, left, bottom, side, tuple(sorted(row[0] for row in sizes)), sum(row[1] for row in sizes) <= _SMALL)


def points_in_polygons(points: DataFrame, cover: Cover, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Points with the key of the polygon they lie in; a point in two polygons appears twice.

    The boundary counts as inside; points outside every polygon and points without coordinates drop. A point has one key for each
    level of the cover that is in use.
    """
    located = F.col(x).isNotNull() & F.col(y).isNotNull() & ~(F.isnan(x) | F.isnan(y))
    width = cover.side

    def cell(value: str, low: float, level: int) -> Column:
        return F.floor((F.col(value) - low) / _size_at(width, F.lit(level))).cast("int")

    spots = F.array(*[
        F.struct(F.lit(n).alias("level"), cell(x, cover.left, n).alias("cx"), cell(y, cover.bottom, n).alias("cy")) for n in cover.levels
    ])
    own = [F.col(f"`{c}`") for c in points.columns]
    in_root = F.col(x).between(cover.left, cover.left + width) & F.col(y).between(cover.bottom, cover.bottom + width)
    if not cover.levels:
        spots = F.array().cast("array<struct<level:int,cx:int,cy:int>>")
    placed = points.where(located & in_root).select(*own, F.explode(spots).alias("_spot"))
    placed = placed.select(*own, *(F.col(f"_spot.{c}").alias(f"_{c}") for c in ("level", "cx", "cy")))
    joined = placed.join(cover.joinable(), ["_level", "_cx", "_cy"])
    size = _size_at(width, F.col("_level"))
    anchor = _anchor(cover.left, F.col("_cx"), size), _anchor(cover.bottom, F.col("_cy"), size)
    kept = joined.where(F.col("_edges").isNull() | inside_from_anchor(x, y, "_edges", *anchor, "_inside"))
    return kept.select(*own, *cover.keys)


# ---------------------------------------------------------------------------------------- grids

# The break list in use.
DENSITY_BREAKS = (1, 100, 250, 500, 1000, 5000, 10000, 20000, 30000)


@dataclass(frozen=True)
class Grid:
    """Rows x columns over a box. Row 0 is at the top, column 0 at the left."""

    xmin: float
    xmax: float
    ymin: float
    ymax: float
    rows: int
    cols: int

    @property
    def cell_width(self) -> Column:
        return (F.lit(self.xmax) - F.lit(self.xmin)) / F.lit(float(self.cols))

    @property
    def cell_height(self) -> Column:
        return (F.lit(self.ymax) - F.lit(self.ymin)) / F.lit(float(self.rows))

    def column_of(self, x: ColumnLike) -> Column:
        """Column index; the right border belongs to the last column, outside is NULL."""
        px, low, high = col_of(x), F.lit(self.xmin), F.lit(self.xmax)
        index = F.floor((px - low) * (F.lit(float(self.cols)) / (high - low))).cast("int")
        return F.when(px.between(low, high), F.least(index, F.lit(self.cols - 1)))

    def row_of(self, y: ColumnLike) -> Column:
        """Row index from the top; the bottom border belongs to the last row, outside is NULL."""
        py, low, high = col_of(y), F.lit(self.ymin), F.lit(self.ymax)
        index = F.floor((high - py) * (F.lit(float(self.rows)) / (high - low))).cast("int")
        return F.when(py.between(low, high), F.least(index, F.lit(self.rows - 1)))

    def center_x(self, column: ColumnLike) -> Column:
        return F.lit(self.xmin) + (col_of(column) + 0.5) * self.cell_width

    def center_y(self, row: ColumnLike) -> Column:
        return F.lit(self.ymax) - (col_of(row) + 0.5) * self.cell_height


def grid_over(
    points: DataFrame,
    rows: int,
    cols: int,
    x: str = "longitude",
    y: str = "latitude",
    pad: tuple[float, float, float, float] = (0.01, 0.01, 0.01, 0.01),
) -> Grid:
    """Grid over the points' own extent, padded at (left, right, bottom, top).

    Runs one aggregation and fetches its four numbers: as literals they fold into the cell
    expressions, where a subquery would have to be carried through every later use of the grid.
    """
    box = extent(points, x, y).first()
    if box["xmin"] is None or box["ymin"] is None:
        raise ValueError("no points to lay a grid over")
    left, right, bottom, top = pad
    return Grid(box["xmin"] - left, box["xmax"] + right, box["ymin"] - bottom, box["ymax"] + top, rows, cols)


def grid_counts(points: DataFrame, grid: Grid, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Points per occupied cell; points outside the grid are left out."""
    placed = points.select(grid.row_of(y).alias("row"), grid.column_of(x).alias("col"))
    inside = placed.where(F.col("row").isNotNull() & F.col("col").isNotNull())
    return inside.groupBy("row", "col").agg(F.count(F.lit(1)).alias("count"))


def dense_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """Every cell of the grid with its number (row-major from the top left, from 1) and centre."""
    index = spark.range(grid.rows * grid.cols)
    placed = index.select(
        (F.col("id") + 1).cast("int").alias("cell"),
        F.floor(F.col("id") / F.lit(grid.cols)).cast("int").alias("row"),
        (F.col("id") % grid.cols).cast("int").alias("col"),
    )
    return placed.select("*", grid.center_x("col").alias("x"), grid.center_y("row").alias("y"))


def zero_filled_grid(counts: DataFrame, grid: Grid) -> DataFrame:
    """Every cell with its centre and count; ``count2`` is NULL where nothing was seen."""
    cells = dense_cells(counts.sparkSession, grid)
    joined = cells.join(counts, ["row", "col"], "left")
    return joined.select(
        "cell", "row", "col", "x", "y", F.coalesce("count", F.lit(0)).alias("count")
    ).withColumn("count2", null_if_zero("count"))


def grid_table(
    points: DataFrame, shapes: DataFrame, key: str = "park", x: str = "longitude", y: str = "latitude", pad: float = 0.01
) -> DataFrame:
    """Grids of all parks from one scan: ``key, xmin, xmax, ymin, ymax, rows, cols``, a row per park with points.

    ``shapes`` has a row per park, ``key, rows, cols``, and perhaps ``left, right, bottom, top``, the padding of its points' extent.
    """
    pads = [F.coalesce(F.col(c), F.lit(pad)) if c in shapes.columns else F.lit(pad) for c in ("left", "right", "bottom", "top")]
    sized = shapes.select(F.col(key).alias("_of"), F.col("rows").cast("int").alias("rows"), F.col("cols").cast("int").alias("cols"), *[p.alias(f"_p{i}") for i, p in enumerate(pads)])
    located = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~(F.isnan(x) | F.isnan(y)))
    boxes = located.groupBy(key).agg(F.min(x).alias("_w"), F.max(x).alias("_e"), F.min(y).alias("_s"), F.max(y).alias("_n"))
    return boxes.join(sized, F.col(key) == F.col("_of")).select(
        key, (F.col("_w") - F.col("_p0")).alias("xmin"), (F.col("_e") + F.col("_p1")).alias("xmax"),
        (F.col("_s") - F.col("_p2")).alias("ymin"), (F.col("_n") + F.col("_p3")).alias("ymax"), "rows", "cols",
    )


def grid_counts_by(
    points: DataFrame, grids: DataFrame, key: str = "park", x: str = "longitude", y: str = "latitude", listed: DataFrame | None = None
) -> DataFrame:
    """Points per occupied cell of their own park's grid: ``key, row, col, count``.

    The rules of :class:`Grid`, with extents as columns of the joined grid table. Up to 200,000 grids, one row per park, are sent
    to all tasks, so that counts are made before anything is shuffled: a shuffle by park would sort all points of a park in one
    task. Their number is counted when the plan is built; ``listed``, the shapes that the grids are made of, is counted in
    their place where they are not stored and counting them would read the points.
    """
    few = (grids if listed is None else listed).limit(_SMALL + 1).count() <= _SMALL
    named = grids.withColumnRenamed(key, "_of")
    named = F.broadcast(named) if few else named
    px, py = F.col(x), F.col(y)
    joined = points.select(key, px, py).join(named, F.col(key) == F.col("_of"))
    col = F.floor((px - F.col("xmin")) * (F.col("cols").cast("double") / (F.col("xmax") - F.col("xmin")))).cast("int")
    row = F.floor((F.col("ymax") - py) * (F.col("rows").cast("double") / (F.col("ymax") - F.col("ymin")))).cast("int")
    inside = px.between(F.col("xmin"), F.col("xmax")) & py.between(F.col("ymin"), F.col("ymax"))
    placed = joined.where(inside).select(key, F.least(row, F.col("rows") - 1).alias("row"), F.least(col, F.col("cols") - 1).alias("col"))
    return placed.groupBy(key, "row", "col").agg(F.count(F.lit(1)).alias("count"))


def zero_filled_grids(counts: DataFrame, grids: DataFrame, key: str = "park") -> DataFrame:
    """Every cell of every park's grid with its number, centre and count; ``count2`` is NULL where nothing was seen."""
    index = F.explode(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1))
    cells = grids.withColumn("_i", index).select(
        key, (F.col("_i") + 1).alias("cell"), F.floor(F.col("_i") / F.col("cols")).cast("int").alias("row"), (F.col("_i") % F.col("cols")).alias("col"),
        (F.col("xmin") + (F.col("_i") % F.col("cols") + 0.5) * ((F.col("xmax") - F.col("xmin")) / F.col("cols").cast("double"))).alias("x"),
        (F.col("ymax") - (F.floor(F.col("_i") / F.col("cols")) + 0.5) * ((F.col("ymax") - F.col("ymin")) / F.col("rows").cast("double"))).alias("y"),
    )
    joined = cells.join(counts, [key, "row", "col"], "left")
    filled = joined.select(key, "cell", "row", "col", "x", "y", F.coalesce("count", F.lit(0)).alias("count"))
    return filled.withColumn("count2", null_if_zero("count"))


def grid_coverage(cells: DataFrame, cover: Cover, by_polygon: bool = False, own: str | None = None) -> DataFrame:
    """Share of the cells whose centre lies in a polygon that hold at least one record.

    ``own`` names a column of ``cells`` with the key of the polygon that a cell is meant for: others do not count then.
    """
    inside = points_in_polygons(cells.withColumnRenamed(own, "_own") if own else cells, cover, "x", "y")
    if own:
        inside = inside.where(F.col("_own") == F.col(cover.keys[0]))
    grouped = inside.groupBy(*cover.keys) if by_polygon or own else inside.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("count") > 0).alias("occupied")
    ).withColumn("percent", percent("occupied", "cells"))


def density_class(column: ColumnLike, breaks: Sequence[int] = DENSITY_BREAKS) -> Column:
    """Class by a break list: how many breaks the count has reached (0 below the first)."""
    value = col_of(column)
    reached = F.lit(0)
    for edge in breaks:
        reached = reached + (value >= edge).cast("int")
    return reached


def cell_width_m(grid: Grid, latitude: ColumnLike) -> Column:
    """Width of a cell in metres along a parallel."""
    start, parallel = F.lit(grid.xmin), col_of(latitude)
    return haversine_m(start, parallel, start + grid.cell_width, parallel)


# ------------------------------------------------------------------------------------ distances


def crowds(points: DataFrame, left: float, bottom: float, side: float, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Points in the cells of a square, ``side`` / 4^6 wide: ``_px, _py, _points``."""
    size = side / _CUT**_POINT_LEVELS
    spot = F.floor((F.col(x) - left) / size).cast("int").alias("_px"), F.floor((F.col(y) - bottom) / size).cast("int").alias("_py")
    located = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~(F.isnan(x) | F.isnan(y)))
    return located.select(*spot).groupBy("_px", "_py").agg(F.count(F.lit(1)).alias("_points"))


def nearest_lists(
    edges: DataFrame, crowd: DataFrame, left: float, bottom: float, side: float, layer: str = "layer", most: int = 12, least: int = 64
) -> DataFrame:
    """Edges that may be nearest in each cell of a square: ``layer, _level, _cx, _cy, edge``.

    A cell keeps the edges no farther from its centre than the nearest one and the cell's diagonal together. One with more than
    ``most`` edges and more than ``least`` points (of :func:`crowds`) is cut in 4 x 4, and its parts choose among its edges only:
    depth follows lines and points, and the work on edges stays below that on points. Lines that run together stay together,
    down to 1/4096 of the square.
    """
    found = cut_lineage(edges.select(
        F.col(layer), F.lit(0).alias("_level"), F.lit(0).alias("_cx"), F.lit(0).alias("_cy"), F.struct("x1", "y1", "x2", "y2").alias("edge")
    ))
    keys, leaves = [layer, "_level", "_cx", "_cy"], []
    crowd = cut_lineage(crowd)
    for level in range(_POINT_LEVELS + 1):
        fine = _CUT ** (_POINT_LEVELS - level)
        cell = F.floor(F.col("_px") / fine).cast("int").alias("_cx"), F.floor(F.col("_py") / fine).cast("int").alias("_cy")
        full = crowd.groupBy(*cell).agg(F.sum("_points").alias("_points")).where(F.col("_points") > least).select("_cx", "_cy")
        many = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n")
        many = cut_lineage(many.join(full, ["_cx", "_cy"]).select(*keys))
        if level == _POINT_LEVELS or many.isEmpty():
            leaves.append(found)
            break
        leaves.append(found.join(many, keys, "left_anti"))
        size = side / _CUT ** (level + 1)
        steps = F.array(*[F.lit(i) for i in range(_CUT)])
        parts = found.join(many, keys).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
        parts = parts.select(
            F.col(layer), F.lit(level + 1).alias("_level"), (F.col("_cx") * _CUT + F.col("_i")).alias("_cx"),
            (F.col("_cy") * _CUT + F.col("_j")).alias("_cy"), "edge",
        )
        centre = left + (F.col("_cx") + 0.5) * size, bottom + (F.col("_cy") + 0.5) * size
        away = parts.withColumn("_away", nearest_edge_distance(*centre, F.array("edge")))
        closest = away.groupBy(*keys).agg(F.min("_away").alias("_least"))
        slack = size * math.sqrt(2.0) * 1.001 + 1e-9 * (abs(left) + abs(bottom) + side)
        found = cut_lineage(away.join(closest, keys).where(F.col("_away") <= F.col("_least") + slack).select(*keys, "edge"))
    return cut_lineage(reduce(DataFrame.unionByName, leaves))


def nearest_features(
    points: DataFrame,
    edges: DataFrame,
    layers: Sequence[str],
    x: str = "longitude",
    y: str = "latitude",
    layer: str = "layer",
    name: str = "distance",
    most: int = 12,
) -> DataFrame:
    """Distance from every point to the nearest line of each layer: one row per point and layer.

    The square around the points is cut by :func:`nearest_lists`; every point then meets the short list of its cell in one join. Fetches the four numbers of the box and the levels in use. Without coordinates, or
    without lines, the distance is NULL.
    """
    box = points.where(~(F.isnan(x) | F.isnan(y))).agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    west, east, south, north = [0.0 if v is None else float(v) for v in box]
    side = (max(east - west, north - south) or 1.0) * 1.01
    left, bottom = west - side * 0.004, south - side * 0.004
    near = edges.where(F.col(layer).isin(*layers))
    kept = nearest_lists(near, crowds(points, left, bottom, side, x, y), left, bottom, side, layer, most)
    lists = kept.groupBy(layer, "_level", "_cx", "_cy").agg(F.collect_list("edge").alias("_edges"))
    in_use: dict[str, list[int]] = {one: [] for one in layers}
    size = 0
    for one, level, n in kept.groupBy(layer, "_level").count().collect():
        in_use[one].append(level)
        size += n
    if size <= _SMALL:
        lists = F.broadcast(lists)

    def cell(value: str, low: float, level: int) -> Column:
        return F.floor((F.col(value) - low) / _size_at(side, F.lit(level))).cast("int")

    def spot(one: str, level: int | None) -> Column:
        at = [F.lit(None).cast("int")] * 3 if level is None else [F.lit(level), cell(x, left, level), cell(y, bottom, level)]
        return F.struct(F.lit(one).alias("layer"), *(c.alias(n) for c, n in zip(at, ("level", "cx", "cy"))))

    located = F.col(x).isNotNull() & F.col(y).isNotNull() & ~(F.isnan(x) | F.isnan(y))
    with_lines = F.array(*[spot(one, n) for one, levels in in_use.items() for n in sorted(levels)])
    without = [spot(one, None) for one, levels in in_use.items() if not levels]
    nowhere = F.array(*[spot(one, None) for one in layers])
    own = [F.col(f"`{c}`") for c in points.columns]
    distance = nearest_edge_distance(x, y, "_edges").alias(name)
    parts = []
    if any(in_use.values()):
        placed = points.where(located).select(*own, F.explode(with_lines).alias("_s"))
        placed = placed.select(*own, F.col("_s.layer").alias(layer), *(F.col(f"_s.{c}").alias(f"_{c}") for c in ("level", "cx", "cy")))
        parts.append(placed.join(lists, [layer, "_level", "_cx", "_cy"]).select(*own, layer, distance))
    blank = F.when(located, F.array(*without) if without else F.array().cast("array<struct<layer:string,level:int,cx:int,cy:int>>"))
    missing = points.select(*own, F.explode(F.coalesce(blank, nowhere)).alias("_s"))
    parts.append(missing.select(*own, F.col("_s.layer").alias(layer), F.lit(None).cast("double").alias(name)))
    return reduce(DataFrame.unionByName, parts)
