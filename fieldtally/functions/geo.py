"""Planar and spherical geometry as column expressions (no Python in the row path).

A polygon or line is an array of edges ``struct<x1,y1,x2,y2>``; all rings of a polygon share one
array, so holes and parts fall out of ray parity by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.types import ColumnLike, col_of

# Fixed value: equatorial radius in metres, used by the distance and by the map projection.
EARTH_RADIUS_M = 6378137.0


def haversine_m(lon1: ColumnLike, lat1: ColumnLike, lon2: ColumnLike, lat2: ColumnLike) -> Column:
    """Great-circle distance in metres; longitude comes first."""
    phi1, phi2 = F.radians(col_of(lat1)), F.radians(col_of(lat2))
    half_dlat = (phi2 - phi1) / 2.0
    half_dlon = F.radians(col_of(lon2) - col_of(lon1)) / 2.0
    h = F.pow(F.sin(half_dlat), F.lit(2.0)) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(half_dlon), F.lit(2.0))
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2.0 * EARTH_RADIUS_M)


def mercator_to_lon(x: ColumnLike) -> Column:
    """Web-Mercator easting in metres to degrees."""
    return F.degrees(col_of(x) / EARTH_RADIUS_M)


def mercator_to_lat(y: ColumnLike) -> Column:
    """Web-Mercator northing in metres to degrees."""
    return F.degrees(F.atan(F.sinh(col_of(y) / EARTH_RADIUS_M)))


def _crosses(edge: Column, x: Column, y: Column) -> Column:
    """Does the edge cross the ray that runs from the point towards +x?

    The half-open test on y comes first, so a horizontal edge never reaches the comparison.
    The side test is a cross product: no division.
    """
    spans = (edge["y1"] > y) != (edge["y2"] > y)
    side = (edge["x2"] - edge["x1"]) * (y - edge["y1"]) - (x - edge["x1"]) * (edge["y2"] - edge["y1"])
    return spans & F.when(edge["y2"] > edge["y1"], side > 0).otherwise(side < 0)


def _touches(edge: Column, x: Column, y: Column) -> Column:
    """Is the point exactly on the edge, ends included?"""
    side = (edge["x2"] - edge["x1"]) * (y - edge["y1"]) - (x - edge["x1"]) * (edge["y2"] - edge["y1"])
    return (
        x.between(F.least(edge["x1"], edge["x2"]), F.greatest(edge["x1"], edge["x2"]))
        & y.between(F.least(edge["y1"], edge["y2"]), F.greatest(edge["y1"], edge["y2"]))
        & (side == 0)
    )


def inside_edges(x: ColumnLike, y: ColumnLike, edges: ColumnLike) -> Column:
    """Point in polygon by ray parity; a point on the boundary counts as inside."""
    px, py, ring = col_of(x), col_of(y), col_of(edges)
    crossings = F.size(F.filter(ring, lambda e: _crosses(e, px, py)))
    return (crossings % 2 == 1) | F.exists(ring, lambda e: _touches(e, px, py))


def _beside(edge: Column, x: Column, y: Column) -> Column:
    """Side of the edge's line a point is on; a point on it counts as moved a little up, and far less to the right."""
    dx, dy = edge["x2"] - edge["x1"], edge["y2"] - edge["y1"]
    side = dx * (y - edge["y1"]) - (x - edge["x1"]) * dy
    return (side > 0) | ((side == 0) & ((dx > 0) | ((dx == 0) & (dy < 0))))


def path_crosses(edge: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Does the path from a point along the x axis to ``x2`` and from there along the y axis to ``y2`` cross the edge an odd number of times?

    Both legs ask on which side of the edge their common corner is, so a corner next to the edge is counted by both or by none.
    """
    corner = _beside(edge, x2, y1)
    level = ((edge["y1"] > y1) != (edge["y2"] > y1)) & (_beside(edge, x1, y1) != corner)
    upright = ((edge["x1"] > x2) != (edge["x2"] > x2)) & (corner != _beside(edge, x2, y2))
    return level != upright


def inside_from_anchor(
    x: ColumnLike, y: ColumnLike, edges: ColumnLike, anchor_x: ColumnLike, anchor_y: ColumnLike, anchor_inside: ColumnLike
) -> Column:
    """Point in polygon from a point near by of which it is known; ``edges`` are those that come near both. The boundary is inside."""
    px, py, ring, ax, ay = (col_of(c) for c in (x, y, edges, anchor_x, anchor_y))
    crossings = F.size(F.filter(ring, lambda e: path_crosses(e, px, py, ax, ay)))
    return (col_of(anchor_inside) != (crossings % 2 == 1)) | F.exists(ring, lambda e: _touches(e, px, py))


def edge_meets_box(edge: Column, left: Column, bottom: Column, size: Column, margin: Column) -> Column:
    """Does the edge come into a square, widened by ``margin`` on all sides? May say yes for an edge that just misses it."""
    low_x, low_y, high_x, high_y = left - margin, bottom - margin, left + size + margin, bottom + size + margin
    apart = (F.greatest(edge["x1"], edge["x2"]) < low_x) | (F.least(edge["x1"], edge["x2"]) > high_x)
    apart = apart | (F.greatest(edge["y1"], edge["y2"]) < low_y) | (F.least(edge["y1"], edge["y2"]) > high_y)
    dx, dy = edge["x2"] - edge["x1"], edge["y2"] - edge["y1"]
    # the centre's distance from the edge's line against the reach of the square across that line
    across = dx * (bottom + size / 2.0 - edge["y1"]) - (left + size / 2.0 - edge["x1"]) * dy
    reach = (F.abs(dx) + F.abs(dy)) * (size / 2.0 + margin)
    return ~apart & (F.abs(across) <= reach)


def _position_along(px: Column, py: Column, edge: Column) -> Column:
    """Where the foot of the point falls on the segment, from 0 to 1; a segment of length 0 is a point."""
    dx, dy = edge["x2"] - edge["x1"], edge["y2"] - edge["y1"]
    along = ((px - edge["x1"]) * dx + (py - edge["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))


def nearest_edge_distance(x: ColumnLike, y: ColumnLike, edges: ColumnLike) -> Column:
    """Planar distance to the nearest edge of an array; NULL for an empty array.

    The position along an edge is bound in a first pass, because expressions inside an array function
    are evaluated as often as they are written.
    """
    px, py = col_of(x), col_of(y)
    placed = F.transform(col_of(edges), lambda e: F.struct(e.alias("e"), _position_along(px, py, e).alias("t")))

    def distance(p: Column) -> Column:
        e, t = p["e"], p["t"]
        return F.hypot(px - (e["x1"] + t * (e["x2"] - e["x1"])), py - (e["y1"] + t * (e["y2"] - e["y1"])))

    return F.array_min(F.transform(placed, distance))
