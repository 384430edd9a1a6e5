"""Operators on paths (..., closed, pts): arcs, stations, hachures, dashes, bands, gaps and clips.

What an expression can say is said in SQL functions; what walks along a path runs in Arrow batches, a path a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from maploom.functions import shapes
from maploom.functions.frames import Frame
from maploom.functions.scales import share
from maploom.operators import kernels
from maploom.operators.sampling import fall_lines

# Names and mark, gap lengths in mm.
LINE_STYLES: dict[str, list[float] | None] = {
    "solid": None, "dashed": [3, 1.5], "fine_dashed": [1.4, 1], "long_dashed": [7, 2], "dotted": [0.4, 1.1],
    "dash_dot": [4, 1.2, 0.4, 1.2], "dash_dot_dot": [4, 1.2, 0.4, 1.2, 0.4, 1.2],
}


class _Row:
    """One row of a batch by column name; a column is turned to Python when first asked for."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch, self.lists, self.at = batch, {}, 0

    def __getitem__(self, name: str):
        if name not in self.lists:
            self.lists[name] = self.batch.column(name).to_pylist()
        return self.lists[name][self.at]


def point_arrays(column: pa.Array) -> list[np.ndarray | None]:
    """The points of each path of a column, shape (n, 2)."""
    flat = column.flatten()
    xy = np.column_stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(2)]).astype(float) if len(flat) else np.empty((0, 2))
    sizes = column.value_lengths().to_pylist()
    out, at = [], 0
    for n in sizes:
        out.append(None if n is None else xy[at : at + n])
        at += n or 0
    return out


def point_column(points: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Points in a row as a column of paths with so many each."""
    points = np.asarray(points, float).reshape(-1, 2)
    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, i])) for i in range(2)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)


def _as_column(values: list, kind: pa.DataType) -> pa.Array:
    if values and isinstance(values[0], np.ndarray):
        return point_column(np.concatenate(values), np.fromiter(map(len, values), np.int64, len(values)))
    return pa.array(values, kind)


def per_path(df: DataFrame, keep: Sequence[str], extra: str, fn: Callable[[np.ndarray, bool, _Row], Iterator[tuple]]) -> DataFrame:
    """keep columns and those of the schema extra, for each tuple that fn(points, closed, row) yields, paths in it as arrays of
    points; a null path yields none."""
    keep = list(keep)
    kinds = to_arrow_schema(T.StructType.fromDDL(extra))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [extra])
    shut = "closed" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, source, out = _Row(batch), [], []
            for i, p in enumerate(point_arrays(batch.column("pts"))):
                if p is not None:
                    row.at = i
                    got = list(fn(p, bool(shut and row["closed"]), row))
                    source += [i] * len(got)
                    out += got
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            held = [batch.column(k).take(pa.array(source, pa.int64())) for k in keep]
            yield pa.RecordBatch.from_arrays([*held, *(_as_column(list(c), k.type) for c, k in zip(cols, kinds, strict=True))], [*keep, *kinds.names])

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- arcs


def vertices(paths: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep, i, x, y, s of each point: s is the distance along the path; a ring's first point comes again at its end."""
    keep = list(keep)
    ring = F.when(F.col("closed"), F.concat("pts", F.slice("pts", 1, 1))).otherwise(F.col("pts"))
    # Paths alike in keep are told apart while the sums are made.
    named = paths.withColumn("_path", F.monotonically_increasing_id()).select(*keep, "_path", F.posexplode(ring).alias("i", "p"))
    points = named.select(*keep, "_path", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return arc_table(points, ["_path"]).drop("_path")


def arc_table(points: DataFrame, keys: Sequence[str], order: str = "i") -> DataFrame:
    """points (keys..., i, x, y) with s, the distance along the path so far, for paths held a point a row."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return points.withColumn("_d", step).withColumn("s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def at_arc(arcs: DataFrame, keys: Sequence[str], stations: DataFrame) -> DataFrame:
    """keys, at, x, y, tx, ty: the points and directions at stations (keys..., at), from an arc table.

    The segment that holds a station is found by a join on the path and a range of its distances.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("i")
    seg = arcs.select(*keys, "x", "y", F.col("s").alias("s0"), F.lead("s").over(w).alias("s1"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.lead("i").over(w).isNotNull().alias("ok"), (F.lead("i", 2).over(w).isNull()).alias("last")).where("ok and s1 > s0")
    hit = seg.join(stations, keys).where((F.col("at") >= F.col("s0")) & ((F.col("at") < F.col("s1")) | (F.col("last") & (F.col("at") == F.col("s1")))))
    f, d = (F.col("at") - F.col("s0")) / (F.col("s1") - F.col("s0")), F.col("s1") - F.col("s0")
    dx, dy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    return hit.select(*keys, "at", (F.col("x") + dx * f).alias("x"), (F.col("y") + dy * f).alias("y"), (dx / d).alias("tx"), (dy / d).alias("ty"))


def straightness(paths: DataFrame, at: float, half: float, keep: Sequence[str]) -> DataFrame:
    """keep, deviation: how far seven points between at - half and at + half stray from the chord; null if the stretch isn't there."""

    def run(p: np.ndarray, closed: bool, row: dict):
        line = kernels.closed_up(p) if closed else p
        s = kernels.arcs(line)
        where = at - half + 2 * half * np.arange(9) / 8
        if closed and s[-1] > 0:
            where = where % s[-1]
        if s[-1] <= 0 or (not closed and (where[0] < 0 or where[-1] > s[-1])):
            yield (None,)
            return
        x, y = np.interp(where, s, line[:, 0]), np.interp(where, s, line[:, 1])
        dx, dy = x[-1] - x[0], y[-1] - y[0]
        d = float(np.hypot(dx, dy))
        yield (float(np.abs((x[1:-1] - x[0]) * dy - (y[1:-1] - y[0]) * dx).max() / d) if d > 0 else None,)

    return per_path(paths, keep, "deviation double", run)


# ---------------------------------------------------------------- hachures


def stations(paths: DataFrame, spacing: float, keep: Sequence[str]) -> DataFrame:
    """keep, k, x, y: a point every spacing along each path, the first after half of it."""
    v = vertices(paths, [*keep, "closed"])
    w = Window.partitionBy(*keep).orderBy("i")
    seg = v.select(*keep, "x", "y", F.col("s").alias("s0"), F.lead("s").over(w).alias("s1"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("s1 > s0")
    first, last = F.ceil(F.col("s0") / spacing - 0.5), F.ceil(F.col("s1") / spacing - 0.5) - 1
    rows = seg.where(last >= first).select("*", F.explode(F.sequence(first, last)).alias("k"))
    t = ((F.col("k") + 0.5) * spacing - F.col("s0")) / (F.col("s1") - F.col("s0"))
    return rows.select(*keep, "k", (F.col("x") + (F.col("x1") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("y1") - F.col("y")) * t).alias("y"))


def hachures(paths: DataFrame, cells: DataFrame, frame: Frame, keep: Sequence[str], spacing: float | None = None, max_length: float | None = None, min_length: float | None = None, min_slope: float = 0, fixed: bool = False, uphill: bool = False) -> DataFrame:
    """keep, k, ax, ay, bx, by, slope: ticks down the fall line, longer where it is steeper, over the slopes met."""
    spacing = spacing if spacing and spacing > 0 else frame.cell * 2
    longest = max_length if max_length and max_length > 0 else frame.cell * 2
    shortest = min(longest * 0.35 if min_length is None else min_length, longest)
    at = stations(paths, spacing, keep).withColumn("station", F.struct(*keep, "k"))
    fall = fall_lines(at.select("station", "x", "y"), cells, frame, "station").where("slope is not null").where(F.col("slope") >= min_slope)
    rows = at.join(fall, "station")
    # One row.
    span = F.broadcast(fall.agg(F.min("slope").alias("_lo"), F.max("slope").alias("_hi")))
    length = F.lit(float(longest)) if fixed else shortest + (longest - shortest) * share(F.col("slope"), F.col("_lo"), F.col("_hi"), 1.0)
    sign = -1 if uphill else 1
    rows = rows.join(span).withColumn("_l", length).where("_l > 0")
    return rows.select(*keep, "k", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + sign * F.col("dx") * F.col("_l")).alias("bx"), (F.col("y") + sign * F.col("dy") * F.col("_l")).alias("by"), "slope")


# ---------------------------------------------------------------- styles, bands, gaps, clips


def dashed(paths: DataFrame, pattern: Sequence[float] | None, keep: Sequence[str]) -> DataFrame:
    """keep, mark, pts: the marks of each path."""
    keep, pattern = list(keep), list(pattern) if pattern else None
    shut = "closed" in paths.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in paths.select(*keep).schema] + ["mark int, pts " + shapes.POINTS])

    def run(batches):
        for batch in batches:
            closed = batch.column("closed").to_pylist() if shut else [False] * len(batch)
            for at in range(0, len(batch), 256):
                part = point_arrays(batch.column("pts").slice(at, 256))
                made = [(at + i, *kernels.marks(p, bool(closed[at + i]), pattern)) for i, p in enumerate(part) if p is not None]
                if made:
                    source, points, sizes = zip(*made, strict=True)
                    n = [len(x) for x in sizes]
                    which = pa.array(np.repeat(np.array(source, np.int64), n))
                    mark = np.concatenate([np.arange(k) for k in n]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(which) for k in keep), pa.array(mark), point_column(np.concatenate(points), np.concatenate(sizes))], [*keep, "mark", "pts"])

    return paths.mapInArrow(run, schema)


def styled(paths: DataFrame, style: str, keep: Sequence[str]) -> DataFrame:
    return dashed(paths, LINE_STYLES.get(style), keep)


def bands(paths: DataFrame, width: float | str, keep: Sequence[str]) -> DataFrame:
    """keep, ring, hole, pts: strokes as areas of a width, given or from a column."""
    def run(p, closed, row):
        for i, (r, hole) in enumerate(kernels.band(p, row[width] if isinstance(width, str) else width, closed)):
            yield i, hole, r

    return per_path(paths, keep, "ring int, hole boolean, pts " + shapes.POINTS, run)


def band_area(rings: DataFrame, keep: Sequence[str]) -> DataFrame:
    area = F.abs(shapes.ring_area2(F.col("pts"))) / 2
    return rings.groupBy(*keep).agg(F.sum(F.when(F.col("hole"), -area).otherwise(area)).alias("area"))


def band_fills(paths: DataFrame, width: float, spacing: float, keep: Sequence[str]) -> DataFrame:
    return per_path(paths, keep, "line int, pts " + shapes.POINTS, lambda p, closed, row: ((i, x) for i, x in enumerate(kernels.band_fill(p, width, spacing, closed))))


def gapped(paths: DataFrame, boxes: str, keep: Sequence[str]) -> DataFrame:
    """keep, part, closed, pts: paths with gaps where boxes, an array column of cx, cy, hw, hh, angle, lie."""
    def run(p, closed, row):
        given = [(b["cx"], b["cy"], b["hw"], b["hh"], b["angle"]) for b in (row[boxes] if row[boxes] is not None else [])]
        for i, (x, shut) in enumerate(kernels.without_boxes(p, closed, given)):
            yield i, shut, x

    return per_path(paths, keep, "part int, closed boolean, pts " + shapes.POINTS, run)


def clip_segments(segments: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, t0, t1 of the stretches of segments (keys..., ax, ay, bx, by) inside the rings of edges (cx, cy, ex, ey).

    Crossings come from a join of each segment with the edges whose boxes it meets; the even-odd test of a stretch's middle from a
    second one. Edges are dealt out by horizontal strips of the plane, so that both are equi-joins on a strip.
    """
    keys = list(keys)
    height = edges.agg(F.avg(F.abs(F.col("ey") - F.col("cy")))).first()[0] or 1.0
    strip = max(height, 1e-9) * 2
    strips = lambda lo, hi: F.sequence(F.floor(lo / strip), F.floor(hi / strip))
    e = edges.select("cx", "cy", "ex", "ey", F.explode(strips(F.least("cy", "ey"), F.greatest("cy", "ey"))).alias("strip"))
    s = segments.select(*keys, "ax", "ay", "bx", "by", F.explode(strips(F.least("ay", "by"), F.greatest("ay", "by"))).alias("strip"))
    dx, dy, rx, ry = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("ex") - F.col("cx"), F.col("ey") - F.col("cy")
    den = dx * ry - dy * rx
    t = F.when(den != 0, ((F.col("cx") - F.col("ax")) * ry - (F.col("cy") - F.col("ay")) * rx) / den)
    u = F.when(den != 0, ((F.col("cx") - F.col("ax")) * dy - (F.col("cy") - F.col("ay")) * dx) / den)
    meet = s.join(e, "strip").where((F.greatest("ax", "bx") >= F.least("cx", "ex")) & (F.least("ax", "bx") <= F.greatest("cx", "ex"))).select(*keys, t.alias("t"), u.alias("u")).where("t > 0 and t < 1 and u >= 0 and u <= 1")
    cuts = meet.groupBy(*keys).agg(F.sort_array(F.collect_set("t")).alias("cuts"))
    ts = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    pairs = F.zip_with(F.slice(ts, 1, F.size(ts) - 1), F.slice(ts, 2, F.size(ts)), lambda a, b: F.struct(a.alias("t0"), b.alias("t1")))
    spans = segments.join(cuts, keys, "left").select(*keys, "ax", "ay", "bx", "by", F.explode(pairs).alias("p")).select(*keys, "ax", "ay", "bx", "by", "p.t0", "p.t1").where("t1 - t0 >= 1e-12")
    mid = (F.col("t0") + F.col("t1")) / 2
    spans = spans.withColumn("mx", F.col("ax") + dx * mid).withColumn("my", F.col("ay") + dy * mid).withColumn("strip", F.floor(F.col("my") / strip))
    a, b = F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")), F.struct(F.col("ex").alias("x"), F.col("ey").alias("y"))
    odd = spans.join(e, "strip").where(shapes.crosses(F.col("mx"), F.col("my"), a, b)).groupBy(*keys, "t0", "t1").agg((F.count("*") % 2 == 1).alias("odd"))
    return odd.where("odd").select(*keys, "t0", "t1")


def clip_drawing(paths: DataFrame, rings: Column | list[np.ndarray], keep: Sequence[str], spare: Column | None = None) -> DataFrame:
    """keep, piece, closed, pts, whole: paths clipped to a few rings held by the driver; spared ones and untouched ones stay as they are."""
    given = [np.asarray(r, float) for r in rings]
    rows = paths.withColumn("_spare", F.lit(False) if spare is None else spare)

    def run(p, closed, row):
        if row["_spare"]:
            yield 0, closed, p, True
            return
        pieces = kernels.clip_to_rings(p, closed, given)
        same = len(pieces) == 1 and len(pieces[0]) == len(p) + closed and np.array_equal(pieces[0][: len(p)], p)
        if same:
            yield 0, closed, p, True
            return
        for i, x in enumerate(pieces):
            yield i, False, x, False

    return per_path(rows, keep, "piece int, closed boolean, pts " + shapes.POINTS + ", whole boolean", run)


def clip_circles(circles: DataFrame, rings: list[np.ndarray]) -> DataFrame:
    """Circles (x, y, radius) whose centre and eight rim points lie inside the rings."""
    import math

    given = F.array(*[shapes.points(*[(F.lit(float(x)), F.lit(float(y))) for x, y in r]) for r in rings])
    ok = shapes.in_rings(F.col("x"), F.col("y"), given)
    for k in range(8):
        a = 2 * math.pi * k / 8
        ok = ok & shapes.in_rings(F.col("x") + F.col("radius") * math.cos(a), F.col("y") + F.col("radius") * math.sin(a), given)
    return circles.where(ok)
