"""Geometry expressions on boxes and points (doubles, page points)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def center_x() -> Column:
    return (F.col("x0") + F.col("x1")) / 2


def center_y() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def corners() -> Column:
    """A box's corners, clockwise from the top left."""
    return F.array(*(point(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))


def rotated(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    """A point turned about the origin."""
    turn = F.radians(degrees)
    return x * F.cos(turn) - y * F.sin(turn), x * F.sin(turn) + y * F.cos(turn)


def edge_angle(a: Column, b: Column) -> Column:
    """Degrees of the way from point a to point b."""
    return F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


#: Polygons of up to so many known corners are tested edge by edge, without an array of edges for each point.
KNOWN_CORNERS = 64


def in_polygon(x: Column, y: Column, points: Column | Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule: is the number of edges that a ray to the right crosses odd?  Each edge owns its upper
    end only, so a ray through a corner counts once; fewer than three corners hold nothing.  ``points`` is an array of
    points, or the corners as pairs of numbers, if they are known beforehand: that is much faster."""
    if not isinstance(points, Column):
        if len(points) <= KNOWN_CORNERS:
            corners_of = [(float(a), float(b)) for a, b in points]
            return let(point(x, y), lambda p: _in_known(p["x"], p["y"], corners_of))
        points = F.array(*(point(F.lit(float(a)), F.lit(float(b))) for a, b in points))
    edges = F.zip_with(points, F.concat(F.slice(points, F.size(points), 1), F.slice(points, 1, F.size(points) - 1)), lambda b, a: F.struct(a.alias("a"), b.alias("b")))

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return spans & (x < (a["x"] - b["x"]) * (y - b["y"]) / F.nullif(a["y"] - b["y"], F.lit(0.0)) + b["x"])

    return (F.size(points) >= 3) & (F.size(F.filter(edges, crossed)) % 2 == 1)


def _in_known(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    if len(points) < 3:
        return F.lit(False)
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(points, [points[-1], *points[:-1]], strict=True):
        if ay != by:  # a level edge is not crossed
            spans = (F.lit(ay) > y) != (F.lit(by) > y)
            crossed = crossed + F.when(spans & (x < F.lit(ax - bx) * (y - by) / F.lit(ay - by) + bx), 1).otherwise(0)
    return crossed % 2 == 1


def nearest(value: Column, centers: Column) -> Column:
    """1-based place of the center nearest to a value, the first of equally near ones."""
    distances = F.transform(centers, lambda c, i: F.struct(F.abs(value - c).alias("d"), (i + 1).alias("i")))
    return F.array_min(distances)["i"]


def bucket(value: Column, boundaries: Column) -> Column:
    """1-based column of a value: boundaries strictly below it, plus one."""
    return F.size(F.filter(boundaries, lambda b: value > b)) + 1


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Starts of tiles along an axis; the last one is moved back to end at the edge."""
    stride = max(1, tile - overlap)
    last = length - tile
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(F.array_sort(F.array_union(regular, F.array(last))))
