"""Iso-lines: marching over triangles, chaining, clipping."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.functions import shapes
from maploom.functions.frames import Frame
from maploom.functions.scales import is_index
from maploom.operators.focal import padded_by_edge, quads
from maploom.operators.graph import ranked
from maploom.operators.paths import point_column
from maploom.plans.storage import stored

#: Rows and columns of a block, within which a task chains a level's segments; their pieces are chained by joins.
BLOCK = 512


def nudged(level: Column) -> Column:
    """A level moved off exact cell values, so that no crossing falls on a corner."""
    return level + (F.abs(level) + 1) * 1e-9


def march(cells: DataFrame, ncols: int, interval: float | None = None, levels: Sequence[float] | None = None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """level, ka, kb, ax, ay, bx, by: the segments of each level, high ground on the left, in grid units.

    Levels are the multiples of interval within [lo, hi], or those given. Each square of cells looks only at the levels
    between its own extremes, which it works out by itself, so nothing is joined. A square is cut into two triangles;
    one with an unmeasured corner yields nothing. Crossing keys are the cell numbers at the two ends of the crossed edge.
    """
    q = quads(cells.select("r", "c", F.col("z").cast("double").alias("z")))
    least, most = F.least("a", "b", "d", "e"), F.greatest("a", "b", "d", "e")
    if levels is not None:
        given = F.array(*[F.lit(float(v)) for v in levels]) if levels else F.array().cast("array<double>")
    else:
        first, last = F.ceil(least / interval - 1), F.floor(most / interval + 1)
        given = F.transform(F.sequence(first, last), lambda k: k * F.lit(float(interval)))
        given = F.filter(given, lambda v: v.between(F.lit(float(lo)) - 1e-12, F.lit(float(hi)) + 1e-12)) if lo is not None else given
    # Both triangles share b and d; where a or e is unmeasured, the other one is still looked at.
    hits = F.filter(given, lambda v: (least <= nudged(v)) & (most >= nudged(v)))
    rows = q.where("b is not null and d is not null").select("r", "c", "a", "b", "d", "e", F.explode(hits).alias("level")).withColumn("L", nudged(F.col("level")))
    corner = lambda dr, dc, v: F.struct(((F.col("r") + dr).cast("long") * ncols + F.col("c") + dc).alias("i"), (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.col(v).alias("z"))
    a, b, d, e = corner(0, 0, "a"), corner(0, 1, "b"), corner(1, 0, "d"), corner(1, 1, "e")
    rows = rows.select("level", "L", F.explode(F.array(F.array(a, d, b), F.array(b, d, e))).alias("v"))
    rows = rows.where("v[0].z is not null and v[1].z is not null and v[2].z is not null")
    up = [F.col("v")[i]["z"] > F.col("L") for i in range(3)]
    count = sum((u.cast("int") for u in up[1:]), up[0].cast("int"))
    rows = rows.withColumn("count", count).where("count in (1, 2)")
    odd = lambda i: up[i] == (F.col("count") == 1)
    rows = rows.withColumn("k", F.when(odd(0), 0).when(odd(1), 1).otherwise(2))
    at = lambda step: F.element_at("v", ((F.col("k") + step) % 3 + 1).cast("int"))

    def crossing(u: Column, w: Column) -> Column:
        low, high = F.when(u["i"] < w["i"], u).otherwise(w), F.when(u["i"] < w["i"], w).otherwise(u)
        t = (F.col("L") - low["z"]) / (high["z"] - low["z"])
        return F.struct(F.struct(low["i"].alias("lo"), high["i"].alias("hi")).alias("key"), (low["c"] + t * (high["c"] - low["c"]) + 0.5).alias("x"), (low["r"] + t * (high["r"] - low["r"]) + 0.5).alias("y"))

    rows = rows.select("level", "L", "count", at(0).alias("u"), at(1).alias("v1"), at(2).alias("v2"))
    rows = rows.select("level", "count", crossing(F.col("u"), F.col("v1")).alias("p"), crossing(F.col("u"), F.col("v2")).alias("q"))
    one = F.col("count") == 1
    rows = rows.select("level", F.when(one, F.col("p")).otherwise(F.col("q")).alias("s"), F.when(one, F.col("q")).otherwise(F.col("p")).alias("t"))
    return rows.select("level", F.col("s.key").alias("ka"), F.col("t.key").alias("kb"), F.col("s.x").alias("ax"), F.col("s.y").alias("ay"), F.col("t.x").alias("bx"), F.col("t.y").alias("by"))


_KEY = "struct<lo: bigint, hi: bigint>"
_PIECES = f"level double, a {_KEY}, b {_KEY}, closed boolean, pts {shapes.POINTS}, low {_KEY}, low_at int"


def _chained(rows: pa.Table) -> pa.Table:
    """The pieces of one group of segments: from starts that are no end first, then rings. A ring begins at its least key, and its last
    point isn't its first again; low is the least key that a piece has, after low_at segments."""
    lo, hi = (np.concatenate([rows[f"{side}_{end}"].to_numpy() for side in "ab"]) for end in ("lo", "hi"))
    ax, ay, bx, by = (rows[k].to_numpy() for k in ("ax", "ay", "bx", "by"))
    n = len(ax)
    # Keys as ranks: starts and ends that are the same share one, and ranks are in the order of the keys.
    order = np.lexsort((hi, lo))
    fresh = np.ones(2 * n, bool)
    fresh[1:] = (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)
    rank = np.empty(2 * n, np.int64)
    rank[order] = np.cumsum(fresh) - 1
    a, b = rank[:n], rank[n:]
    at = np.full(2 * n, -1)
    at[a] = np.arange(n)
    follows = np.zeros(2 * n, bool)
    follows[b] = True
    after, left = at[b].tolist(), bytearray(b"\1") * n
    flat: list[int] = []
    begun = []
    for i in np.lexsort((a, follows[a])).tolist():
        if left[i]:
            begun.append(len(flat))
            while i >= 0 and left[i]:
                left[i] = 0
                flat.append(i)
                i = after[i]
    run, start = np.array(flat, np.int64), np.array(begun, np.int64)
    size = np.diff(start, append=n)
    first, last = run[start], run[start + size - 1]
    closed = b[last] == a[first]
    # Each piece's first point, then where its segments end.
    head = start + np.arange(len(start))
    xy = np.empty((n + len(start), 2))
    inner = np.ones(len(xy), bool)
    inner[head] = False
    xy[head], xy[inner] = np.column_stack([ax, ay])[first], np.column_stack([bx, by])[run]
    whole = np.ones(len(xy), bool)
    whole[(head + size)[closed]] = False
    low = np.minimum.reduceat(a[run], start) if n else a
    low_at = np.flatnonzero(a[run] == np.repeat(low, size)) - start
    pair = lambda i: pa.StructArray.from_arrays([pa.array(lo[i]), pa.array(hi[i])], ["lo", "hi"])
    level = pa.array(np.full(len(start), rows["level"][0].as_py() if n else 0.0))
    columns = [level, pair(first), pair(n + last), pa.array(closed), point_column(xy[whole], size + 1 - closed), pair(run[start + low_at]), pa.array(low_at.astype(np.int32))]
    return pa.Table.from_arrays(columns, ["level", "a", "b", "closed", "pts", "low", "low_at"])


def chain(segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """level, path, closed, pts: the segments of each level joined end to start, in grid units; rings repeat no point.

    A task chains the segments of one level in one block of the raster, however large that is; the pieces that go on in another
    block are far fewer, and are ranked along their paths by joins that double their reach. A path's points are gathered at the end.
    """
    at = lambda p, q, name: F.floor((F.col(p) + F.col(q)) / 2 / block).cast("int").alias(name)
    flat = segments.select("level", F.col("ka.lo").alias("a_lo"), F.col("ka.hi").alias("a_hi"), F.col("kb.lo").alias("b_lo"), F.col("kb.hi").alias("b_hi"), "ax", "ay", "bx", "by", at("ay", "by", "br"), at("ax", "bx", "bc"))
    pieces = stored(flat.groupBy("level", "br", "bc").applyInArrow(_chained, _PIECES), "pieces")
    opened = pieces.where("not closed")
    starts, ends = opened.select("level", F.col("a").alias("key")), opened.select("level", F.col("b").alias("key"))
    # Where one piece ends and another starts.
    met = stored(starts.join(ends, ["level", "key"], "left_semi"), "met")
    whole = pieces.select("level", F.col("a").alias("path"), "closed", "pts")
    if not met.limit(1).count():
        return whole
    # Pieces that meet none are whole already.
    hit = lambda side, name: met.select("level", F.col("key").alias(side), F.lit(True).alias(name))
    marked = opened.join(hit("a", "before"), ["level", "a"], "left").join(hit("b", "after"), ["level", "b"], "left")
    linked = stored(marked.where("before or after").select("level", "a", "b", "pts", "low", "low_at"), "linked")
    order = ranked(linked.select("level", "a", "b"), ["level"])
    got = linked.join(order, ["level", "a"]).groupBy("level", "path", "closed").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "low", "low_at", "pts"))).alias("s"))
    rest = F.flatten(F.transform("s", lambda s: F.slice(s["pts"], 2, F.size(s["pts"]))))
    got = got.withColumn("pts", F.concat(F.slice(F.col("s")[0]["pts"], 1, 1), rest))
    # A ring begins at its least key, wherever the blocks cut it.
    got = got.withColumn("least", F.array_min(F.transform("s", lambda s: F.struct(s["low"].alias("low"), s["pos"].alias("pos"), s["low_at"].alias("at")))))
    before = F.aggregate("s", F.lit(0), lambda n, s: n + F.when(s["pos"] < F.col("least.pos"), F.size(s["pts"]) - 1).otherwise(0)) + F.col("least.at")
    n = F.size("pts") - 1
    ring = F.concat(F.slice("pts", before + 1, n - before), F.slice("pts", F.lit(1), before))
    joined = got.select("level", F.when(F.col("closed"), F.col("least.low")).otherwise(F.col("s")[0]["a"]).alias("path"), "closed", F.when(F.col("closed"), ring).otherwise(F.col("pts")).alias("pts"))
    alone = marked.where("before is null and after is null").select("level", F.col("a").alias("path"), F.lit(False).alias("closed"), "pts")
    return whole.where("closed").unionByName(alone).unionByName(joined)


def clip_to_rectangle(paths: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """paths (..., closed, pts) cut at a rectangle, with piece: a path inside stays whole and closed, others fall into open pieces."""
    keep = [c for c in paths.columns if c not in ("closed", "pts")]
    b = shapes.bbox(F.col("pts"))
    rows = paths.withColumn("_b", b).where((F.col("_b.x1") >= x0) & (F.col("_b.x0") <= x1) & (F.col("_b.y1") >= y0) & (F.col("_b.y0") <= y1))
    whole = (F.col("_b.x0") >= x0) & (F.col("_b.x1") <= x1) & (F.col("_b.y0") >= y0) & (F.col("_b.y1") <= y1)
    inside = rows.where(whole).select(*keep, F.lit(0).alias("piece"), "closed", "pts")
    cut = F.transform(shapes.edges(F.col("pts"), F.col("closed")), lambda e: shapes.clipped_segment(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], x0, y0, x1, y1))
    # A piece ends where a segment is lost, or leaves the rectangle before its end.
    empty = F.array().cast(f"array<{shapes.POINTS}>")
    state = F.struct(empty.alias("done"), F.array().cast(shapes.POINTS).alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        flushed = F.when(F.size(acc["cur"]) > 1, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        longer = F.concat(F.when(F.size(acc["cur"]) == 0, F.array(shapes.point(s["ax"], s["ay"]))).otherwise(acc["cur"]), F.array(shapes.point(s["bx"], s["by"])))
        none = F.array().cast(shapes.POINTS)
        return (F.when(s.isNull(), F.struct(flushed.alias("done"), none.alias("cur")))
                .when(s["t1"] < 1, F.struct(F.concat(acc["done"], F.array(longer)).alias("done"), none.alias("cur")))
                .otherwise(F.struct(acc["done"].alias("done"), longer.alias("cur"))))

    pieces = F.aggregate(cut, state, step, lambda acc: F.when(F.size(acc["cur"]) > 1, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))
    other = rows.where(~whole).select(*keep, F.posexplode(pieces).alias("piece", "pts")).select(*keep, "piece", F.lit(False).alias("closed"), "pts")
    return inside.unionByName(other)


def to_map(paths: DataFrame, frame: Frame) -> DataFrame:
    """pts from grid units to map units."""
    return paths.withColumn("pts", F.transform("pts", lambda p: shapes.point(*frame.to_map(p["x"], p["y"]))))


def trace(cells: DataFrame, frame: Frame, interval: float, lo: float, hi: float, index_every: int = 0, min_points: int = 2, min_length: float = 0, edge: str = "extent") -> DataFrame:
    """level, path, piece, closed, index, pts in map units: the contours of a raster out to its edge.

    The raster gets a ring of repeated edge cells, and the lines are clipped to the extent; edge="centres" does neither.
    lo and hi bound the levels, as from focal.stats.
    """
    pad = edge != "centres"
    ncols = frame.ncols + 2 * pad
    grid = padded_by_edge(cells, frame.nrows, frame.ncols).select((F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c"), "z") if pad else cells
    paths = chain(march(grid, ncols, interval, lo=lo, hi=hi))
    if pad:
        paths = paths.withColumn("pts", F.transform("pts", lambda p: shapes.point(p["x"] - 1, p["y"] - 1)))
    paths = to_map(paths, frame)
    paths = clip_to_rectangle(paths, frame.origin_x, frame.south, frame.east, frame.origin_y) if pad else paths.withColumn("piece", F.lit(0))
    paths = paths.where(F.size("pts") >= max(2, min_points))
    if min_length > 0:
        paths = paths.where(shapes.path_length(F.col("pts"), F.col("closed")) >= min_length)
    return paths.select("level", "path", "piece", "closed", is_index(F.col("level"), F.lit(float(interval)), index_every).alias("index"), "pts")
