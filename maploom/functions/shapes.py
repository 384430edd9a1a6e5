"""Geometry on arrays of points, array<struct<x: double, y: double>>, without leaving the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x: double, y: double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def points(*xy: tuple[Column, Column]) -> Column:
    return F.array(*[point(x, y) for x, y in xy])


def edges(pts: Column, closed: bool | Column = True) -> Column:
    """array<struct<a, b>> of consecutive points, the last to the first if closed."""
    n = F.size(pts)
    ring = F.concat(pts, F.when(F.lit(closed) if isinstance(closed, bool) else closed, F.slice(pts, 1, 1)).otherwise(F.slice(pts, 1, 0)))
    pairs = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.size(ring)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(n > 1, pairs).otherwise(F.slice(pairs, 1, 0))


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, e: s + f(e))


def ring_area2(pts: Column) -> Column:
    """Twice the signed area, positive counter-clockwise."""
    return _sum(edges(pts), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])


def path_length(pts: Column, closed: bool | Column = False) -> Column:
    return _sum(edges(pts, closed), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def bbox(pts: Column) -> Column:
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def crosses(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Whether a ray from (x, y) to the east meets the edge a-b; an edge owns its lower end."""
    # The quotient is only looked at where the ends differ in y; the inner test keeps ANSI division from failing elsewhere.
    run = F.when(b["y"] != a["y"], (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]))
    return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < run + a["x"], F.lit(False))


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd: inside if the ray meets an odd number of edges of rings, an array of point arrays."""
    every = F.flatten(F.transform(rings, lambda r: edges(r)))
    return F.size(F.filter(every, lambda e: crosses(x, y, e["a"], e["b"]))) % 2 == 1


def moved(pts: Column, x: Column, y: Column) -> Column:
    return F.transform(pts, lambda p: point(p["x"] + x, p["y"] + y))


def turned(pts: Column, cx: Column, cy: Column, radians: Column) -> Column:
    c, s = F.cos(radians), F.sin(radians)
    return F.transform(pts, lambda p: point(cx + (p["x"] - cx) * c - (p["y"] - cy) * s, cy + (p["x"] - cx) * s + (p["y"] - cy) * c))


def clipped_segment(ax: Column, ay: Column, bx: Column, by: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The part of a segment inside a rectangle, null if there is none: struct<t0, t1, ax, ay, bx, by>."""
    dx, dy = bx - ax, by - ay

    def bounds(p: Column, q: Column):
        """The share of the segment from and up to which p * t <= q, and whether a parallel one is inside."""
        t = F.when(p != 0, q / p)
        return F.when(p < 0, t), F.when(p > 0, t), (p != 0) | (q >= 0)

    limits = [bounds(-dx, ax - x0), bounds(dx, x1 - ax), bounds(-dy, ay - y0), bounds(dy, y1 - ay)]
    t0 = F.greatest(F.lit(0.0), *[x[0] for x in limits])
    t1 = F.least(F.lit(1.0), *[x[1] for x in limits])
    ok = limits[0][2] & limits[1][2] & limits[2][2] & limits[3][2] & (t0 <= t1)
    return F.when(ok, F.struct(t0.alias("t0"), t1.alias("t1"), (ax + dx * t0).alias("ax"), (ay + dy * t0).alias("ay"), (ax + dx * t1).alias("bx"), (ay + dy * t1).alias("by")))


def regular(cx: Column, cy: Column, r: Column, n: int, start: float = 0.0, inner: float | None = None) -> Column:
    """n points round a centre, every second at inner * r if given."""
    out = []
    for k in range(n):
        a = start + 2 * math.pi * k / n
        q = r * inner if inner is not None and k % 2 else r
        out.append((cx + q * math.cos(a), cy + q * math.sin(a)))
    return points(*out)
