"""Fill patterns: families of strokes over boxes, cut to regions.

A family is a table of strokes made by SQL functions from row and column numbers, for every region of a table at once, so
that fills of any number and size are generated on the executors. fill_features() turns each region, lays the family over
its box, keeps what lies inside, and turns back.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.functions import shapes
from maploom.functions.hashing import cell_random
from maploom.operators import kernels
from maploom.operators.paths import point_arrays, point_column

#: Spacing of a solid fill, width of a burnt line.
SOLID_MM = 0.3
BURN_MM = SOLID_MM * 1.15


@dataclass(frozen=True)
class Box:
    """What a family covers: a centre and half sizes, as columns."""

    cx: Column
    cy: Column
    half: Column
    half_y: Column


def _box() -> Box:
    """The box in the struct f of a table of regions."""
    return Box(*(F.col(f"f.{n}") for n in ("cx", "cy", "half", "half_y")))


def _long(c: Column) -> Column:
    return c.cast("long")


def _rows(base: DataFrame, cy: Column, half: Column, s: Column) -> DataFrame:
    """f, j and y of rows s apart, j from 0 at the south."""
    n = _long(F.floor(half / s)) + 1
    rows = base.select("*", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), 2 * n)).alias("j"))
    return rows.select(*base.columns, F.col("j").cast("int").alias("j"), (cy + (F.col("j") - F.col("n")) * s).alias("y"), F.col("n").cast("int").alias("n"))


def _along(rows: DataFrame, start: Column, stop: Column, step: Column, inclusive: bool = False) -> DataFrame:
    """Each row times k and x = start + k * step up to stop."""
    count = F.floor((stop - start) / step + 1e-9) if inclusive else F.ceil((stop - start) / step - 1e-9) - 1
    return rows.where(count >= 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), _long(count))).alias("k")).withColumn("x", start + F.col("k") * step)


def _line(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return shapes.points((x0, y0), (x1, y1))


def _strokes(rows: DataFrame, pts: Column) -> DataFrame:
    return rows.select("f", pts.alias("pts"))


Family = Callable[[DataFrame, Box, Column], DataFrame]


def lines(base: DataFrame, b: Box, s: Column, half_y: Column | None = None) -> DataFrame:
    return _strokes(_rows(base, b.cy, b.half if half_y is None else half_y, s), _line(b.cx - b.half, F.col("y"), b.cx + b.half, F.col("y")))


# Fixed values in the families below: shares of the spacing.
def double_lines(base, b, s):
    two = _rows(base, b.cy, b.half, s).select("f", F.explode(F.array(F.col("y"), F.col("y") + 0.28 * s)).alias("y"))
    return _strokes(two, _line(b.cx - b.half, F.col("y"), b.cx + b.half, F.col("y")))


def dashes(base, b, s, dash=1.5, gap=0.75):
    end = b.cx + b.half
    rows = _along(_rows(base, b.cy, b.half, s), b.cx - b.half, end, (dash + gap) * s)
    return _strokes(rows, _line(F.col("x"), F.col("y"), F.least(F.col("x") + dash * s, end), F.col("y")))


def dash_dots(base, b, s):
    end = b.cx + b.half
    rows = _along(_rows(base, b.cy, b.half, s), b.cx - b.half, end, 2.4 * s)
    dash = _line(F.col("x"), F.col("y"), F.least(F.col("x") + 1.4 * s, end), F.col("y"))
    at = F.col("x") + 1.9 * s
    both = F.when(at < end, F.array(dash, _line(at, F.col("y"), at + 0.06 * s, F.col("y")))).otherwise(F.array(dash))
    return _strokes(rows, F.explode(both))


def _woven(rows: DataFrame, points: Column) -> DataFrame:
    """One stroke a row from the points at each x."""
    got = rows.groupBy("f", "j", "y").agg(F.array_sort(F.collect_list(F.struct("k", points.alias("p")))).alias("s"))
    return _strokes(got.where(F.size("s") > 1), F.transform("s", lambda e: e["p"]))


def zigzag(base, b, s):
    rows = _along(_rows(base, b.cy, b.half, s), b.cx - b.half, b.cx + b.half, s, inclusive=True)
    return _woven(rows, shapes.point(F.col("x"), F.col("y") + F.when(F.col("k") % 2 == 1, 0.38 * s).otherwise(-0.38 * s)))


def waves(base, b, s, length=3.2, height=0.35, alternate=False):
    rows = _along(_rows(base, b.cy, b.half, s), b.cx - b.half, b.cx + b.half, length * s / 8, inclusive=True)
    phase = F.when(F.col("j") % 2 == 1, math.pi).otherwise(0.0) if alternate else F.lit(0.0)
    return _woven(rows, shapes.point(F.col("x"), F.col("y") + height * s * F.sin(2 * math.pi * F.col("x") / (length * s) + phase)))


def ripples(base, b, s):
    return waves(base, b, s, 2.0, 0.5, True)


def scales(base, b, s):
    r = 0.8 * s
    start = b.cx - b.half + F.when(F.col("j") % 2 == 1, r * 0.85).otherwise(0.0)
    rows = _along(_rows(base, b.cy, b.half, 0.7 * r), start, b.cx + b.half, 2 * r * 0.85)
    return _strokes(rows, shapes.points(*[(F.col("x") + r * math.cos(math.pi * k / 8), F.col("y") + r * 0.55 * math.sin(math.pi * k / 8)) for k in range(9)]))


def _lattice(base: DataFrame, ni: Column, nj: Column) -> DataFrame:
    """All i in -ni..ni and j in -nj..nj."""
    span = lambda n: F.explode(F.sequence(-n.cast("int"), n.cast("int")))
    return base.select("*", span(ni).alias("i")).select("*", span(nj).alias("j"))


def herringbone(base, b, s):
    n = F.floor(b.half / s) + 1
    x, y = b.cx + F.col("i") * s, b.cy + F.col("j") * s
    even = F.pmod(F.col("i") + F.col("j"), F.lit(2)) == 0
    return _strokes(_lattice(base, n, n), F.when(even, _line(x, y, x + s, y + s)).otherwise(_line(x, y + s, x + s, y)))


def brick(base, b, s):
    rows = _rows(base, b.cy, b.half, s).withColumn("odd", F.pmod(F.col("j") - F.col("n"), F.lit(2)) == 1)
    joints = _along(rows, b.cx - b.half + F.when(F.col("odd"), s).otherwise(0.0), b.cx + b.half, 2 * s)
    return lines(base, b, s).unionByName(_strokes(joints, _line(F.col("x"), F.col("y"), F.col("x"), F.col("y") + s)))


def honeycomb(base, b, s):
    a, root = 0.7 * s, math.sqrt(3)
    ni, nj = F.floor(b.half / (1.5 * a)) + 2, F.floor(b.half / (root * a)) + 2
    x = b.cx + F.col("i") * 1.5 * a
    y = b.cy + F.col("j") * root * a + F.when(F.pmod(F.col("i"), F.lit(2)) == 1, root / 2 * a).otherwise(0.0)
    return _strokes(_lattice(base, ni, nj), shapes.points(*[(x + a * math.cos(math.pi / 3 * k), y + a * math.sin(math.pi / 3 * k)) for k in range(4)]))


def _turned(df: DataFrame, b: Box, *degrees: float) -> DataFrame:
    out = df
    for d in degrees:
        out = out.unionByName(_strokes(df, shapes.turned(F.col("pts"), b.cx, b.cy, F.lit(math.radians(d)))))
    return out


#: Families of strokes by name.
LINE_FAMILIES: dict[str, Family] = {
    "solid": lambda base, b, s: lines(base, b, s, b.half_y), "lines": lambda base, b, s: lines(base, b, s, b.half_y), "double": double_lines, "dashes": dashes, "dashdot": dash_dots,
    "cross": lambda base, b, s: _turned(lines(base, b, s), b, 90), "trigrid": lambda base, b, s: _turned(lines(base, b, 1.2 * s), b, 60, 120),
    "zigzag": zigzag, "waves": waves, "ripples": ripples, "scales": scales, "herringbone": herringbone, "brick": brick, "hex": honeycomb,
    "interference": lambda base, b, s: _turned(waves(base, b, s, 2.6, 0.4), b, 60),
}


@dataclass(frozen=True)
class Scatter:
    """A mark on a lattice: spacing in x and y, whether odd rows stand between, jitter, room it needs, and its strokes."""

    gx: Column
    gy: Column
    stagger: bool
    jitter: float
    margin: Column
    make: Callable[[Column, Column, Column], list[Column]]


def _circle(x: Column, y: Column, r: Column, n: int) -> Column:
    return shapes.points(*[(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n + 1)])


def _tick(x, y, a, ln):
    return _line(x - ln / 2 * F.cos(a), y - ln / 2 * F.sin(a), x + ln / 2 * F.cos(a), y + ln / 2 * F.sin(a))


def scatter(name: str, s: Column) -> Scatter:
    dot, ring, speck = F.greatest(F.lit(0.15), 0.12 * s), 0.45 * s, F.greatest(F.lit(0.12), 0.07 * s)
    arm, long_, tall = 0.3 * s, 0.55 * s, 0.62 * s
    w, h = 0.42 * s, 0.65 * s
    reed_w, reed_h = 0.55 * s, 0.45 * s
    made = {
        "dots": Scatter(s, s, False, 0, dot, lambda x, y, u: [_circle(x, y, dot, 6)]),
        "rings": Scatter(1.5 * s, 1.3 * s, True, 0, ring, lambda x, y, u: [_circle(x, y, ring, 10)]),
        "stipple": Scatter(0.62 * s, 0.62 * s, False, 0.45, speck, lambda x, y, u: [_circle(x, y, speck, 5)]),
        "pebbles": Scatter(1.15 * s, 1.15 * s, True, 0.32, 0.55 * s, lambda x, y, u: [_circle(x, y, (0.22 + 0.3 * u) * s, 9)]),
        "plus": Scatter(1.3 * s, 1.3 * s, True, 0, arm, lambda x, y, u: [_line(x - arm, y, x + arm, y), _line(x, y - arm, x, y + arm)]),
        "ticks": Scatter(0.95 * s, 0.95 * s, False, 0.4, long_, lambda x, y, u: [_tick(x, y, math.pi * u, long_)]),
        "grass": Scatter(1.35 * s, 1.15 * s, True, 0.3, tall, lambda x, y, u: [_line(x, y, x + tall * F.sin(a + (u - 0.5) * 0.35), y + tall * F.cos(a + (u - 0.5) * 0.35)) for a in (-0.32, 0.0, 0.3)]),
        "marsh": Scatter(2.1 * s, 1.55 * s, True, 0.15, F.greatest(reed_w, reed_h), lambda x, y, u: [_line(x - reed_w, y, x + reed_w, y)] + [_line(x + d, y, x + d, y + reed_h) for d in (-0.5 * reed_w, F.lit(0.0), 0.5 * reed_w)]),
        "diamonds": Scatter(1.5 * s, 1.7 * s, True, 0, F.greatest(w, h), lambda x, y, u: [shapes.points((x, y - h), (x + w, y), (x, y + h), (x - w, y), (x, y - h))]),
    }
    return made[name]


SCATTERS = ("dots", "rings", "stipple", "pebbles", "plus", "ticks", "grass", "marsh", "diamonds")
PATTERNS = (*LINE_FAMILIES, *SCATTERS, "echo")


def scattered(base: DataFrame, name: str, b: Box, s: Column, rings: str | None = None, most: int | None = None) -> DataFrame:
    """f, i, j, x, y, pts of a scatter over the boxes of base (f, ...); with rings, a column of base, only marks that lie inside
    with their margin. With most, a box that would take more symbols is thinned by halves again until it doesn't: symbols
    are then left out, and thinned_fills counts such boxes."""
    m = scatter(name, s)
    wider = F.lit(1.0) if most is None else _thinning(b, m, most)
    gx, gy = m.gx * wider, m.gy * wider
    ni, nj = F.floor(b.half / gx) + 1, F.floor(b.half / gy) + 1
    x, y = b.cx + F.col("i") * gx, b.cy + F.col("j") * gy
    if m.stagger:
        x = x + F.when(F.pmod(F.col("j"), F.lit(2)) == 1, gx / 2).otherwise(0.0)
    if m.jitter:
        x = x + (cell_random(F.col("i"), F.col("j"), 1) - 0.5) * m.jitter * gx * 2
        y = y + (cell_random(F.col("i"), F.col("j"), 2) - 0.5) * m.jitter * gy * 2
    rows = _lattice(base, ni, nj).withColumn("x", x).withColumn("y", y)
    if rings is not None:
        zero = F.lit(0.0)
        for dx, dy in ((zero, zero), (-m.margin, zero), (m.margin, zero), (zero, -m.margin), (zero, m.margin)):
            rows = rows.where(shapes.in_rings(F.col("x") + dx, F.col("y") + dy, F.col(rings)))
    return rows.select("f", "i", "j", "x", "y", F.explode(F.array(*m.make(F.col("x"), F.col("y"), cell_random(F.col("i"), F.col("j"), 3)))).alias("pts"))


def _thinning(b: Box, m: Scatter, most: int) -> Column:
    """How often 1.5 times the spacing is needed for at most `most` symbols, as a factor."""
    symbols = (2 * b.half / m.gx) * (2 * b.half / m.gy)
    return F.pow(F.lit(1.5), F.greatest(F.ceil(F.log(symbols / most) / (2 * math.log(1.5))), F.lit(0)))


def regions(features: DataFrame, spacing: Column | float, rotation_deg: Column | float, keep: list[str], most_rows: int | None = None) -> DataFrame:
    """f (keep..., cx, cy, half, half_y, s, turn, mx, my) and work, the rings turned flat, of features (keep..., rings).

    With most_rows, a spacing that would take more rows is widened to take that many.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    rows = features.select(*keep, F.filter("rings", lambda r: F.size(r) > 0).alias("rings"), as_col(spacing).cast("double").alias("s"), F.radians(as_col(rotation_deg).cast("double")).alias("turn")).where(F.size("rings") > 0)
    bounds = lambda c: shapes.bbox(F.flatten(c))
    rows = rows.withColumn("b", bounds("rings")).withColumn("mx", (F.col("b.x0") + F.col("b.x1")) / 2).withColumn("my", (F.col("b.y0") + F.col("b.y1")) / 2)
    rows = rows.withColumn("work", F.transform("rings", lambda r: shapes.turned(r, F.col("mx"), F.col("my"), -F.col("turn")))).withColumn("b", bounds("work"))
    wide, high = F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")
    rows = rows.withColumn("half_y", high / 2 + 1)
    s = F.when(F.col("s") > 0, F.col("s")).otherwise(2.0)
    s = s if most_rows is None else F.greatest(s, 2 * F.col("half_y") / most_rows)
    f = F.struct(*keep, ((F.col("b.x0") + F.col("b.x1")) / 2).alias("cx"), ((F.col("b.y0") + F.col("b.y1")) / 2).alias("cy"), (F.hypot(wide, high) / 2 + 1).alias("half"), "half_y", s.alias("s"), "turn", "mx", "my")
    return rows.select(f.alias("f"), "work")


def fill_features(features: DataFrame, keep: list[str], pattern: str = "lines", spacing: Column | float = 2, rotation_deg: Column | float = 45, min_length: float = 1, most_rows: int | None = None, most_symbols: int | None = None) -> DataFrame:
    """keep, pts: each feature's fill; features (keep..., rings) have an outline and its holes as rings, left out by the even-odd rule.

    Spacing and rotation may differ by feature. Fills are as dense as asked; most_rows and most_symbols, if given, widen and
    thin those that are denser, see regions and scattered. A feature without points has no fill.
    """
    if pattern not in PATTERNS or pattern == "echo":
        raise ValueError(f"unknown fill pattern {pattern!r}")
    base = regions(features, SOLID_MM if pattern == "solid" else spacing, rotation_deg, keep, most_rows)
    b, s = _box(), F.col("f.s")
    # A stroke finds its feature's rings again by what names the feature.
    if pattern in LINE_FAMILIES:
        raw = LINE_FAMILIES[pattern](base.select("f"), b, s)
    else:
        raw = scattered(base, pattern, b, s, "work", most_symbols).select("f", "pts")
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in features.select(*keep).schema)

    def cut(key, strokes: pa.Table, region: pa.Table) -> pa.Table:
        names = [*keep, "pts"]
        if not strokes.num_rows:
            return _cut_schema.empty_table()
        f = region.column("of")[0].as_py()
        work = [np.array([(p["x"], p["y"]) for p in r]) for r in region.column("work")[0].as_py()]
        a, mid = f["turn"], np.array([f["mx"], f["my"]])
        turn = np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
        out = [(x - mid) @ turn + mid for chunk in strokes.column("pts").chunks for p in point_arrays(chunk) for x in kernels.clip_to_rings(p, False, work) if kernels.run_length(x) >= min_length]
        held = [pa.array([f[k]] * len(out), _cut_schema.field(k).type) for k in keep]
        pts = point_column(np.concatenate(out) if out else np.empty((0, 2)), np.array([len(x) for x in out], np.int64))
        return pa.Table.from_arrays([*held, pts], names)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"{kinds + ', ' if kinds else ''}pts {shapes.POINTS}"
    _cut_schema = to_arrow_schema(T.StructType.fromDDL(schema))
    return raw.groupBy("f").cogroup(base.select(F.col("f").alias("of"), "work").groupBy("of")).applyInArrow(cut, schema)


def fill(spark: SparkSession, rings: list[np.ndarray], pattern: str = "lines", spacing: float = 2, rotation_deg: float = 45, min_length: float = 1, most_rows: int | None = None, most_symbols: int | None = None) -> DataFrame:
    """pts: the fill of one region held by the driver."""
    if pattern == "echo":
        return echo(spark, rings, spacing if spacing > 0 else 2, min_length)
    one = spark.createDataFrame([(0, [[(float(x), float(y)) for x, y in r] for r in rings])], f"id int, rings array<{shapes.POINTS}>")
    return fill_features(one, ["id"], pattern, spacing, rotation_deg, min_length, most_rows, most_symbols).select("pts")


def distance_field(spark: SparkSession, rings: list[np.ndarray], cell: float) -> tuple[DataFrame, int, int, float, float]:
    """(r, c, z; rows, columns, west, north): the distance of cell centres to the rings, negative outside."""
    every = np.vstack(rings)
    (x0, y0), (x1, y1) = every.min(axis=0), every.max(axis=0)
    ncols, nrows = max(4, math.ceil((x1 - x0) / cell) + 3), max(4, math.ceil((y1 - y0) / cell) + 3)
    west, north = x0 - cell, y1 + cell
    given = F.array(*[shapes.points(*[(F.lit(float(p)), F.lit(float(q))) for p, q in r]) for r in rings])
    rows = spark.range(nrows * ncols).select(F.floor(F.col("id") / ncols).cast("int").alias("r"), (F.col("id") % ncols).cast("int").alias("c"))
    rows = rows.withColumn("x", F.lit(west) + (F.col("c") + 0.5) * cell).withColumn("y", F.lit(north) - (F.col("r") + 0.5) * cell)

    def far(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        long_ = dx * dx + dy * dy
        t = F.when(long_ > 0, F.least(F.greatest(((F.col("x") - e["a"]["x"]) * dx + (F.col("y") - e["a"]["y"]) * dy) / long_, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        return F.hypot(F.col("x") - (e["a"]["x"] + dx * t), F.col("y") - (e["a"]["y"] + dy * t))

    best = F.array_min(F.transform(F.flatten(F.transform(given, lambda r: shapes.edges(r))), far))
    return rows.select("r", "c", F.when(shapes.in_rings(F.col("x"), F.col("y"), given), best).otherwise(-best).alias("z")), nrows, ncols, west, north


def echo(spark: SparkSession, rings: list[np.ndarray], spacing: float, min_length: float, most_cells: int | None = None) -> DataFrame:
    """Lines inside a region at whole spacings from its edge: the contours of its distance field, a quarter of the spacing fine.
    With most_cells, a field with more cells along its longer side is made coarser."""
    from maploom.functions.frames import Frame
    from maploom.operators.contours import trace

    every = np.vstack(rings)
    size = every.max(axis=0) - every.min(axis=0)
    cell = spacing / 4 if most_cells is None else max(spacing / 4, float(size.max()) / most_cells)
    field, nrows, ncols, west, north = distance_field(spark, rings, cell)
    top = field.agg(F.max(F.col("z").cast("float"))).first()[0]
    n = math.ceil(top / spacing) - 1
    lines_ = trace(field, Frame(nrows, ncols, cell, west, north), spacing, spacing, n * spacing) if n >= 1 else None
    if lines_ is None:
        return spark.createDataFrame([], "pts " + shapes.POINTS)
    pts = F.when(F.col("closed"), F.concat("pts", F.slice("pts", 1, 1))).otherwise(F.col("pts"))
    return lines_.select(pts.alias("pts")).where(shapes.path_length(F.col("pts")) >= min_length)


def solid_rows(rings: DataFrame, keep: list[str], solid_mm: float = SOLID_MM, burn_mm: float = BURN_MM) -> DataFrame:
    """keep, row, pts: level strokes that fill convex rings (keep..., pts), the first and the last half a burn inside, and the
    others evenly between them, no further apart than solid_mm. Where a ring is narrower than a burn a dot stands for the
    stroke, and under 0.05 mm nothing does. A ring that isn't convex is filled from its west to its east edge."""
    half = burn_mm / 2
    b = shapes.bbox(F.col("pts"))
    rows = rings.select(*keep, "pts", b.alias("_b")).where("_b is not null").withColumn("_span", F.col("_b.y1") - F.col("_b.y0") - burn_mm)
    rows = rows.withColumn("_n", F.when(F.col("_span") > 0, F.ceil(F.col("_span") / solid_mm) + 1).otherwise(1).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("row"))
    y = F.when(F.col("_n") > 1, F.col("_b.y0") + half + F.col("row") * F.col("_span") / (F.col("_n") - 1)).otherwise((F.col("_b.y0") + F.col("_b.y1")) / 2)
    rows = rows.withColumn("_y", y)
    crossed = F.filter(shapes.edges(F.col("pts")), lambda e: (e["a"]["y"] > F.col("_y")) != (e["b"]["y"] > F.col("_y")))
    at = F.transform(crossed, lambda e: e["a"]["x"] + (F.col("_y") - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]))
    rows = rows.withColumn("_x", at).withColumn("_w", F.array_min("_x")).withColumn("_e", F.array_max("_x"))
    wide = F.col("_e") - F.col("_w")
    mid = (F.col("_w") + F.col("_e")) / 2
    stroke = F.when(wide - burn_mm > 1e-9, shapes.points((F.col("_w") + half, F.col("_y")), (F.col("_e") - half, F.col("_y"))))
    stroke = stroke.when(wide > 0.05, shapes.points((mid, F.col("_y")), (mid + 1e-6, F.col("_y"))))
    return rows.withColumn("pts", stroke).where("pts is not null").select(*keep, "row", "pts")
