"""Circles, scanline hatching and halftones out of rasters and images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maploom.functions.colour import CHANNELS
from maploom.functions.frames import Frame
from maploom.functions.scales import clamp01, nice_step


def _first(origin: float, stride: int) -> int:
    """The first row or column whose place in the world is a multiple of the stride."""
    return math.floor(origin + 0.5) % stride


def symbol_field(cells: DataFrame, frame: Frame, stride: int = 1, threshold: float = 0, min_fraction: float = 0.08, max_fraction: float = 1, lo: float | None = None, hi: float | None = None, invert: bool = False) -> DataFrame:
    """r, c, x, y, radius, v: a circle at every stride-th cell of the world's grid, its radius linear in the value.

    lo and hi default to the extremes of all cells, not only of those sampled. Unmeasured cells have no circle.
    """
    stride = max(1, math.floor(stride + 0.5))
    bounds = None
    if lo is None or hi is None:
        # One row.
        bounds = F.broadcast(cells.agg(F.min("z").cast("double").alias("_lo"), F.max("z").cast("double").alias("_hi")))
    r0, c0 = _first(frame.origin_y / frame.cell, stride), -math.floor(frame.origin_x / frame.cell + 0.5) % stride
    rows = cells.where((F.col("z").isNotNull()) & (F.pmod(F.col("r") - r0, F.lit(stride)) == 0) & (F.pmod(F.col("c") - c0, F.lit(stride)) == 0) & (F.col("r") >= r0) & (F.col("c") >= c0))
    rows = rows.join(bounds) if bounds is not None else rows.withColumn("_lo", F.lit(float(lo))).withColumn("_hi", F.lit(float(hi)))
    span = F.col("_hi") - F.col("_lo")
    t = F.when(span > 0, clamp01((F.col("z").cast("double") - F.col("_lo")) / span)).otherwise(F.lit(0.0))
    t = 1 - t if invert else t
    full = stride * frame.cell * max_fraction / 2
    rows = rows.withColumn("_t", t).where(F.col("_t") >= threshold)
    return rows.select("r", "c", frame.easting(F.col("c")).alias("x"), frame.northing(F.col("r")).alias("y"), (full * (min_fraction + (1 - min_fraction) * F.col("_t"))).alias("radius"), F.col("z").cast("double").alias("v"))


def signed_symbol_field(cells: DataFrame, frame: Frame, stride: int = 1, min_abs: float = 0, min_fraction: float = 0.08, max_fraction: float = 1, hi: float | None = None) -> DataFrame:
    """symbol_field of the sizes of the values with one scale for both signs; v keeps its sign, zeros have no circle."""
    if hi is None or hi <= 0:
        hi = cells.agg(F.max(F.abs("z")).cast("double")).first()[0]
    if not hi:
        return symbol_field(cells.limit(0), frame, stride, lo=0, hi=1)
    sizes = cells.where("z != 0").select("r", "c", F.abs("z").alias("z"), F.signum("z").alias("s"))
    got = symbol_field(sizes.select("r", "c", "z"), frame, stride, min_abs / hi, min_fraction, max_fraction, 0, hi)
    return got.join(sizes.select("r", "c", "s"), ["r", "c"]).select("r", "c", "x", "y", "radius", (F.col("v") * F.col("s")).alias("v"))


def legend(lo: float, hi: float, stride: int = 1, cell: float = 1, min_fraction: float = 0.08, max_fraction: float = 1, count: int = 3) -> list[tuple[float, float]]:
    """(value, radius) at the round steps between lo and hi."""
    if hi <= lo:
        return []
    step = nice_step((hi - lo) / (max(2, count) - 1))
    full = max(1, math.floor(stride + 0.5)) * cell * max_fraction / 2
    first = math.ceil(lo / step)
    out, k = [], first
    while k * step <= hi + step * 1e-6:
        out.append((round(k * step, 10), full * (min_fraction + (1 - min_fraction) * (k * step - lo) / (hi - lo))))
        k += 1
    return out


def circle_chords(circles: DataFrame, spacing: float, angle_deg: float = 45, min_length: float = 0) -> DataFrame:
    """circles (..., x, y, radius) with i, ax, ay, bx, by: parallel chords, centred, spacing apart."""
    a = math.radians(angle_deg)
    ux, uy = math.cos(a), math.sin(a)
    k = F.floor(F.col("radius") / spacing)
    rows = circles.where("radius > 0").select("*", F.explode(F.sequence(-k, k)).alias("i"))
    d = F.col("i") * spacing
    half = F.sqrt(F.greatest(F.col("radius") * F.col("radius") - d * d, F.lit(0.0)))
    rows = rows.withColumn("_h", half).where((F.col("_h") * 2 >= min_length) & (F.col("_h") > 1e-9))
    mx, my = F.col("x") - uy * d, F.col("y") + ux * d
    ends = [(mx - ux * F.col("_h")).alias("ax"), (my - uy * F.col("_h")).alias("ay"), (mx + ux * F.col("_h")).alias("bx"), (my + uy * F.col("_h")).alias("by")]
    return rows.select(*circles.columns, "i", *ends)


def on_sheet(circles: DataFrame, width: float, height: float) -> DataFrame:
    """Circles (x, y, radius in mm) that lie on the sheet whole."""
    return circles.where((F.col("x") - F.col("radius") >= 0) & (F.col("x") + F.col("radius") <= width) & (F.col("y") - F.col("radius") >= 0) & (F.col("y") + F.col("radius") <= height))


def hatch_field(cells: DataFrame, frame: Frame, lo: float, hi: float, spacing: float | None = None, step: float | None = None, angle_deg: float = 45, min_mark: float = 0, floor: float | None = None, invert: bool = False) -> DataFrame:
    """line, t, ax, ay, bx, by: ink along parallel scanlines that are fixed in the world.

    Each step of a line is inked in proportion to the cell under its middle; steps of at least 98 % run together into
    one mark. Steps over unmeasured cells or below floor have none. Marks are cut at the extent; short ones go. A line is
    looked at where it meets the extent and two steps beyond, so steps grow with the cells; t is where a mark begins before it is cut.
    """
    spacing = spacing if spacing and spacing > 0 else frame.cell * 4
    step = step if step and step > 0 else spacing
    a = math.radians(angle_deg)
    ux, uy = math.cos(a), math.sin(a)
    nx, ny = -uy, ux
    corners = [(x, y) for x in (frame.origin_x, frame.east) for y in (frame.south, frame.origin_y)]
    s_all, t_all = [x * nx + y * ny for x, y in corners], [x * ux + y * uy for x, y in corners]
    k0, k1 = math.ceil(min(s_all) / spacing) - 1, math.floor(max(s_all) / spacing) + 1
    t0 = math.floor(min(t_all) / step) * step - step
    steps = max(0, math.ceil((max(t_all) + step - t0) / step))
    spark = cells.sparkSession
    lines = spark.range(k0, k1 + 1).select(F.col("id").alias("line"), (F.col("id") * spacing).alias("s"))
    # From where to where along it a line is inside.
    starts, stops = [F.lit(t0)], [F.lit(t0 + steps * step)]
    for n, u, low, high in ((nx, ux, frame.origin_x, frame.east), (ny, uy, frame.south, frame.origin_y)):
        if u:
            starts.append(((low if u > 0 else high) - F.col("s") * n) / u)
            stops.append(((high if u > 0 else low) - F.col("s") * n) / u)
        else:
            lines = lines.where((F.col("s") * n).between(low, high))
    lines = lines.withColumn("start", F.greatest(*starts)).withColumn("stop", F.least(*stops)).where("start <= stop")
    first, last = F.floor((F.col("start") - t0) / step) - 2, F.floor((F.col("stop") - t0) / step) + 2
    every = F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(steps - 1)).cast("int"))
    rows = lines.select("line", "s", "start", "stop", F.explode(every).alias("j")).withColumn("t", F.lit(t0) + F.col("j") * step)
    mid = F.col("t") + step / 2
    x, y = F.col("s") * nx + mid * ux, F.col("s") * ny + mid * uy
    gx, gy = frame.to_grid(x, y)
    into = lambda v, n: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("int")
    # Spark takes the steps to be as few as the lines, and would broadcast them.
    rows = rows.withColumn("r", into(gy, frame.nrows)).withColumn("c", into(gx, frame.ncols)).join(cells.select("r", "c", "z").hint("merge"), ["r", "c"], "left")
    d = F.lit(1.0) if hi <= lo else clamp01((F.col("z").cast("double") - lo) / (hi - lo))
    d = 1 - d if invert else d
    ok = F.col("z").isNotNull() if floor is None else F.col("z").isNotNull() & (F.col("z") >= floor)
    rows = rows.withColumn("d", F.when(ok, d))
    full = F.col("d") >= 0.98
    order = Window.partitionBy("line").orderBy("j")
    rows = rows.withColumn("full", F.coalesce(full, F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("full") & ~F.coalesce(F.lag("full").over(order), F.lit(False)), 1).otherwise(0)).over(order))
    long_ = rows.where("full").groupBy("line", "s", "start", "stop", "run").agg(F.min("t").alias("a"), (F.max("t") + step).alias("b")).drop("run")
    short = rows.where(~F.col("full") & (F.col("d") > 0)).select("line", "s", "start", "stop", (mid - F.col("d") * step / 2).alias("a"), (mid + F.col("d") * step / 2).alias("b"))
    marks = long_.unionByName(short).where(F.col("b") - F.col("a") >= min_mark)
    at = lambda t: (F.col("s") * nx + F.col(t) * ux, F.col("s") * ny + F.col(t) * uy)
    marks = marks.select("line", "s", F.col("a").alias("t"), F.greatest("a", "start").alias("a"), F.least("b", "stop").alias("b")).where(F.col("b") - F.col("a") >= max(min_mark, 0))
    (ax, ay), (bx, by) = at("a"), at("b")
    return marks.select("line", "t", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))


def block_step(width: int, height: int, across: float) -> int:
    return max(1, math.floor(max(width, height) / max(2, across) + 0.5))


def block_channel(pixels: DataFrame, width: int, height: int, across: float, channel: str | tuple[str, ...]) -> DataFrame:
    """r, c and one column a channel over blocks of pixels (y, x, red, green, blue): means first, then the channel; partial blocks at the ends go."""
    step = block_step(width, height, across)
    names = (channel,) if isinstance(channel, str) else channel
    rows = pixels.where((F.col("x") < width // step * step) & (F.col("y") < height // step * step))
    mean = rows.groupBy(F.floor(F.col("y") / step).cast("int").alias("r"), F.floor(F.col("x") / step).cast("int").alias("c")).agg(*[F.avg(n).alias(n) for n in ("red", "green", "blue")])
    rgb = [F.col(n) for n in ("red", "green", "blue")]
    return mean.select("r", "c", *[CHANNELS[n](*rgb).alias(n) for n in names])


def halftone(pixels: DataFrame, width: int, height: int, frame: Frame, across: float = 90, channels: tuple[str, ...] = ("darkness",), min_fraction: float = 0, max_fraction: float = 0.95, threshold: float = 0.04, invert: bool = False) -> DataFrame:
    """channel, r, c, x, y, radius, v: one circle a block and channel; three channels nest at 1, 0.66 and 0.36 of the greatest radius."""
    step = block_step(width, height, max(4, math.floor(across + 0.5)))
    grid = block_channel(pixels, width, height, max(4, math.floor(across + 0.5)), channels)
    place = Frame(max(1, height // step), max(1, width // step), frame.cell * step, frame.origin_x, frame.origin_y)
    out = None
    for name, share in zip(channels, (1, 0.66, 0.36), strict=False):
        # 0.342 and not 0.34199999999999997, which puts radii on the wrong side of a rounding.
        most = round(max_fraction * share, 12)
        one = symbol_field(grid.select("r", "c", F.col(name).alias("z")), place, 1, threshold, min_fraction, most, 0, 1, invert).select(F.lit(name).alias("channel"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def grey_tile(pixels: DataFrame, channel: str = "luminance", gamma: float = 1, invert: bool = False) -> DataFrame:
    """y, x, grey of 0 to 255, for machines that dither by themselves."""
    v = CHANNELS[channel](F.col("red"), F.col("green"), F.col("blue"))
    v = F.pow(clamp01(v), F.lit(float(gamma))) if gamma != 1 else v
    v = 1 - v if invert else v
    return pixels.select("y", "x", F.least(F.greatest(F.bround(v * 255, 0), F.lit(0.0)), F.lit(255.0)).cast("int").alias("grey"))


def rescaled_bands(pixels: DataFrame) -> DataFrame:
    """Bands beyond 255 are scaled by the greatest value of all; others stay."""
    top = F.broadcast(pixels.agg(F.max(F.greatest("red", "green", "blue")).alias("_top")))
    fit = lambda n: F.when(F.col("_top") > 255, F.col(n) * 255.0 / F.col("_top")).otherwise(F.col(n).cast("double")).alias(n)
    return pixels.join(top).select("y", "x", *[fit(n) for n in ("red", "green", "blue")])


def verdict(marks: Column) -> Column:
    """What a number of dashes means for the machine."""
    return F.when(marks <= 1500, "comfortable").when(marks <= 6000, "heavy").otherwise("very heavy")


