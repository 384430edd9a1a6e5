"""Vector features: attributes bound to strokes, point symbols, holes given to their outlines, photographs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.functions import shapes
from maploom.functions.frames import Frame, to_utm, utm_zone
from maploom.functions.scales import angle_value, scale_value
from maploom.operators.graph import numbered
from maploom.operators.sampling import bilinear

# Mark, gap lengths in mm of feature lines.
LINE_TYPES: dict[str, list[float] | None] = {"solid": None, "dashed": [3.0, 1.5], "dotted": [0.4, 1.1], "dashdot": [3.0, 1.1, 0.4, 1.1], "dashdotdot": [3.0, 1.1, 0.4, 1.1, 0.4, 1.1]}
#: Defaults by kind of geometry.
DEFAULTS = {
    "polygon": {"pattern": "lines", "spacing_mm": 2.0, "rotation_deg": 45, "outline": True, "line_type": "solid", "layer": "DLF-02_score_medium"},
    "line": {"pattern": "solid", "spacing_mm": 0.3, "rotation_deg": 0, "line_type": "dashed", "layer": "DLF-02_score_medium"},
    "point": {"pattern": "none", "spacing_mm": 1.0, "radius_mm": 2.0, "symbol": "circle", "line_type": "solid", "layer": "DLF-02_score_medium"},
}
#: Symbols that look different when turned.
DIRECTIONAL = ("square", "triangle", "diamond", "cross", "star", "arrow")
SYMBOLS = ("circle", *DIRECTIONAL)


def _turn(x: Column, y: Column, rot: Column, shape: list[tuple[Column | float, Column | float]], shut: bool) -> Column:
    c, s = F.cos(rot), F.sin(rot)
    pts = [(x + dx * c - dy * s, y + dx * s + dy * c) for dx, dy in shape]
    return shapes.points(*(pts + pts[:1] if shut else pts))


def symbol_paths(kind: str, x: Column, y: Column, r: Column, rot: Column) -> list[Column]:
    """The strokes of a point symbol whose farthest corner lies at r; closed ones repeat their first point."""
    zero = F.lit(0.0)
    around = lambda n, start=0.0, inner=None: [(r * (inner if inner and k % 2 else 1.0) * math.cos(start + 2 * math.pi * k / n), r * (inner if inner and k % 2 else 1.0) * math.sin(start + 2 * math.pi * k / n)) for k in range(n)]
    if kind == "cross":
        return [_turn(x, y, rot, [(-r, zero), (r, zero)], False), _turn(x, y, rot, [(zero, -r), (zero, r)], False)]
    if kind == "arrow":
        return [_turn(x, y, rot, [(zero, -r), (zero, r)], False), _turn(x, y, rot, [(-r * 0.45, r * 0.45), (zero, r), (r * 0.45, r * 0.45)], False)]
    h = r / math.sqrt(2)
    shape = {"square": [(-h, -h), (h, -h), (h, h), (-h, h)], "triangle": around(3, math.pi / 2), "diamond": [(zero, r), (r, zero), (zero, -r), (-r, zero)], "star": around(10, math.pi / 2, 0.42)}.get(kind)
    return [_turn(x, y, rot, shape or around(24), True)]


def bind(features: DataFrame, attributes: DataFrame, names: Sequence[str], on: str = "ord") -> DataFrame:
    """Features with the attributes of the same place in order; features without a row stay, their attributes null."""
    return features.join(attributes.select(on, *names), on, "left")


def check_pairs(geometries: DataFrame, rows: DataFrame, on: str = "ord") -> None:
    """Raises unless there are as many rows as geometries: pairing goes by order and nothing else."""
    g, r = geometries.select(on).distinct().count(), rows.count()
    if g != r:
        raise ValueError(f"{r} attribute rows for {g} geometries; the attributes are not used")


def driven(value: Column, fixed: float, lo: float, hi: float, out_lo: float, out_hi: float, mode: str = "linear") -> tuple[Column, Column]:
    """(size, unmeasured): a size for a value, or the fixed one and true where there is none."""
    none = value.isNull() | F.isnan(value)
    return F.when(none, F.lit(float(fixed))).otherwise(scale_value(value, F.lit(float(lo)), F.lit(float(hi)), out_lo, out_hi, mode)), none


def point_symbols(points: DataFrame, keep: Sequence[str], symbol: str = "circle", radius: Column | float = 2.0, rotation: Column | float = 0.0, width: float | None = None, height: float | None = None) -> DataFrame:
    """keep, part, pts: symbols at points (keep..., x, y) in sheet mm; points off a sheet of that size go."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    rot = rotation if isinstance(rotation, Column) else F.lit(float(rotation))
    rows = points if width is None else points.where(F.col("x").between(0, width) & F.col("y").between(0, height))
    parts = F.array(*symbol_paths(symbol, F.col("x"), F.col("y"), r, F.coalesce(rot, F.lit(0.0))))
    return rows.select(*keep, F.posexplode(parts).alias("part", "pts"))


def rotation_of(value: Column, lo: float, hi: float, mode: str = "degrees", offset_deg: float = 0) -> Column:
    return F.coalesce(angle_value(value, F.lit(float(lo)), F.lit(float(hi)), mode, offset_deg), F.lit(0.0))


def group_rings(rings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, ring, hole, pts, owner for rings (keys..., ring, hole, pts): the outline that a hole belongs to.

    That is the smallest outline that holds the hole's first point; a hole in none is its own. Holes and outlines meet by
    the columns keys and by strips of the plane that their extents touch.
    """
    keys = list(keys)
    b = shapes.bbox(F.col("pts"))
    outer = rings.where(~F.col("hole")).select(*keys, F.col("ring").alias("owner"), F.col("pts").alias("shape"), (F.abs(shapes.ring_area2(F.col("pts"))) / 2).alias("area"), b.alias("b"))
    height = outer.agg(F.avg(F.col("b.y1") - F.col("b.y0"))).first()[0] or 1.0
    strip = max(height, 1e-9) * 2
    outer = outer.select("*", F.explode(F.sequence(F.floor(F.col("b.y0") / strip), F.floor(F.col("b.y1") / strip))).alias("strip"))
    first = F.col("pts")[0]
    holes = rings.where("hole").select(*keys, "ring", "pts", first.alias("p"), F.floor(first["y"] / strip).alias("strip"))
    inside = holes.join(outer, [*keys, "strip"]).where(F.col("p.x").between(F.col("b.x0"), F.col("b.x1")) & F.col("p.y").between(F.col("b.y0"), F.col("b.y1")))
    inside = inside.where(shapes.in_rings(F.col("p.x"), F.col("p.y"), F.array("shape")))
    best = inside.groupBy(*keys, "ring").agg(F.min_by("owner", F.struct("area", "owner")).alias("owner"))
    held = rings.where("hole").join(best, [*keys, "ring"], "left")
    return rings.where(~F.col("hole")).select(*keys, "ring", "hole", "pts", F.col("ring").alias("owner")).unionByName(held.select(*keys, "ring", "hole", "pts", F.coalesce("owner", "ring").alias("owner")))


# ---------------------------------------------------------------- photographs


def split_photos(photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(located, unlocated), the first with n by time taken and name."""
    located = photos.where("lat is not null and lon is not null")
    named = numbered(located.withColumn("_taken", F.coalesce("taken", F.lit(""))), "n", "_taken", "name").drop("_taken")
    return named, photos.where("lat is null or lon is null")


def place_photos(photos: DataFrame, cells: DataFrame, frame: Frame, zone: int | None = None, south: bool | None = None) -> DataFrame:
    """name, n, x, y, inside, ground of photos (n, name, lat, lon): where they stand on a raster, and its height there.

    The zone is that given, else the raster's, else the first photo's; photographs outside are not to be drawn.
    """
    from maploom.functions.frames import zone_of_epsg

    spark = photos.sparkSession
    if zone is None:
        z, s = spark.range(1).select(*zone_of_epsg(F.lit(frame.crs))).first()
        if z is None:
            first = photos.where("lon is not null").orderBy("n").select(utm_zone(F.col("lon"))).first()
            z, s = (first[0] if first else 33), False
        zone, south = z, s if south is None else south
    x, y = to_utm(F.col("lat"), F.col("lon"), zone, bool(south))
    rows = photos.where("lat is not null and lon is not null").withColumn("x", x).withColumn("y", y)
    gx, gy = frame.to_grid(F.col("x"), F.col("y"))
    rows = rows.withColumn("gx", gx).withColumn("gy", gy).withColumn("inside", frame.inside(F.col("gx"), F.col("gy")))
    got = bilinear(rows, cells, ["name", "n", "x", "y", "inside"], "ground")
    return got.select("name", F.col("n").cast("long").alias("n"), "x", "y", "inside", "ground")


def corrected(placed: DataFrame, moves: DataFrame) -> DataFrame:
    """placed with moves (n, dx, dy) made by hand; raw_x and raw_y keep the measured place."""
    rows = placed.join(moves.select("n", "dx", "dy"), "n", "left").withColumn("raw_x", F.col("x")).withColumn("raw_y", F.col("y"))
    return rows.withColumn("dx", F.coalesce("dx", F.lit(0.0))).withColumn("dy", F.coalesce("dy", F.lit(0.0))).withColumn("x", F.col("raw_x") + F.col("dx")).withColumn("y", F.col("raw_y") + F.col("dy"))


def photo_marks(points: DataFrame, keep: Sequence[str], mark: str = "circle", size: float = 3, bearing: str | None = None, bearing_length: float | None = None) -> DataFrame:
    """keep, part, pts: marks at points (keep..., x, y), with a tick towards the bearing; a circle is a symbol, not a stroke."""
    s = size / 2
    x, y = F.col("x"), F.col("y")
    h = s * 1.15
    parts = {
        "circle": [], "square": [shapes.points((x - s, y - s), (x + s, y - s), (x + s, y + s), (x - s, y + s), (x - s, y - s))],
        "diamond": [shapes.points((x, y - s), (x + s, y), (x, y + s), (x - s, y), (x, y - s))],
        "triangle": [shapes.points((x, y + h), (x + s, y - h * 0.6), (x - s, y - h * 0.6), (x, y + h))],
        "cross": [shapes.points((x - s, y), (x + s, y)), shapes.points((x, y - s), (x, y + s))],
    }[mark]
    if bearing is not None:
        a = (90 - F.col(bearing)) * (math.pi / 180)
        far = s * 3 if bearing_length is None else bearing_length
        tick = shapes.points((x + F.cos(a) * s, y + F.sin(a) * s), (x + F.cos(a) * far, y + F.sin(a) * far))
        parts = [*parts, F.when(F.col(bearing).isNotNull(), tick)]
    if not parts:
        return points.limit(0).select(*keep, F.lit(0).alias("part"), F.array().cast(shapes.POINTS).alias("pts"))
    return points.select(*keep, F.posexplode(F.array(*parts)).alias("part", "pts")).where("pts is not null")


def nearest_point(points: DataFrame, x: float, y: float, within: float) -> DataFrame:
    """The point (n, x, y) nearest to a place, if it lies within reach."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return points.withColumn("distance", d).where(F.col("distance") <= within).orderBy("distance", "n").limit(1)
