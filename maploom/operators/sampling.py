"""Values of a raster at points that aren't cell centres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.functions.frames import Frame
from maploom.operators.focal import quads


def bilinear(points: DataFrame, cells: DataFrame, keep: Sequence[str], name: str = "v") -> DataFrame:
    """keep and the value at each point (keep..., gx, gy) in grid units; null unless all four corners were measured.

    One join on the square that holds the point, against cells folded into squares beforehand.
    """
    q = quads(cells).select(F.col("r").alias("_r"), F.col("c").alias("_c"), "a", "b", "d", "e")
    at = points.withColumn("_x", F.col("gx") - 0.5).withColumn("_y", F.col("gy") - 0.5)
    at = at.withColumn("_r", F.floor("_y").cast("int")).withColumn("_c", F.floor("_x").cast("int"))
    fx, fy = F.col("_x") - F.col("_c"), F.col("_y") - F.col("_r")
    north = F.col("a") * (1 - fx) + F.col("b") * fx
    south = F.col("d") * (1 - fx) + F.col("e") * fx
    return at.join(q, ["_r", "_c"], "left").select(*keep, (north * (1 - fy) + south * fy).alias(name))


def nearest(points: DataFrame, cells: DataFrame, frame: Frame, keep: Sequence[str], name: str = "v") -> DataFrame:
    """keep and the value of the cell that holds each point (keep..., x, y), points outside taking the edge's."""
    into = lambda v, n: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("int")
    gx, gy = frame.to_grid(F.col("x"), F.col("y"))
    at = points.withColumn("r", into(gy, frame.nrows)).withColumn("c", into(gx, frame.ncols))
    return at.join(cells.select("r", "c", F.col("z").alias(name)), ["r", "c"], "left").select(*keep, name)


def fall_lines(points: DataFrame, cells: DataFrame, frame: Frame, key: str) -> DataFrame:
    """key, dx, dy, slope: the unit vector downhill at each point (key, x, y), from samples one cell away on each side.

    Null where a sample is missing or the ground is flat. key names a point once.
    """
    steps = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(dx * frame.cell).alias("dx"), F.lit(dy * frame.cell).alias("dy")) for n, dx, dy in (("e", 1.0, 0.0), ("w", -1.0, 0.0), ("n", 0.0, 1.0), ("s", 0.0, -1.0))])
    four = points.select(key, F.explode(steps).alias("o"), "x", "y")
    gx, gy = frame.to_grid(F.col("x") + F.col("o.dx"), F.col("y") + F.col("o.dy"))
    got = bilinear(four.select(key, F.col("o.n").alias("side"), gx.alias("gx"), gy.alias("gy")), cells, [key, "side"])
    one = lambda side: F.max(F.when(F.col("side") == side, F.col("v")))
    got = got.groupBy(key).agg(((one("e") - one("w")) / (2 * frame.cell)).alias("gx"), ((one("n") - one("s")) / (2 * frame.cell)).alias("gy"))
    size = F.hypot("gx", "gy")
    return got.select(key, F.when(size > 0, -F.col("gx") / size).alias("dx"), F.when(size > 0, -F.col("gy") / size).alias("dy"), F.when(size > 0, size).alias("slope"))


def sections(cells: DataFrame, frame: Frame, count: int = 3, axis: str = "horizontal", height_units: float | None = None, shared: bool = False, samples: int | None = None) -> DataFrame:
    """section, label, j, t, v, x, y, run, exaggeration, lo, hi: parallel cuts as sampled profiles.

    Section i lies i / (count + 1) of the way; one sample a cell, held half a cell inside. Profiles stand on
    their line, height_units for their own relief, or for that of all if shared. Unmeasured samples end a run: run is null
    there and counts up after each gap.
    """
    count = max(1, min(24, round(count)))
    height = height_units if height_units and height_units > 0 else frame.cell * 8
    across = axis != "vertical"
    n = max(2, round(samples if samples is not None else (frame.width if across else frame.height) / frame.cell))
    spark = cells.sparkSession
    rows = spark.range(count * n).select((F.floor(F.col("id") / n) + 1).cast("int").alias("section"), (F.col("id") % n).cast("int").alias("j"))
    t, f = F.col("j") / (n - 1), F.col("section") / (count + 1)
    x = frame.origin_x + (t if across else f) * frame.width
    y = frame.south + (1 - (f if across else t)) * frame.height
    gx, gy = frame.to_grid(x, y)
    held = lambda g, n: F.least(F.greatest(g, F.lit(0.5)), F.lit(max(0.5, n - 0.5 - 1e-6)))
    rows = rows.select("section", "j", t.alias("t"), f.alias("f"), held(gx, frame.ncols).alias("gx"), held(gy, frame.nrows).alias("gy"))
    got = bilinear(rows, cells, ["section", "j", "t", "f"])
    # count sections of n samples: the windows are over one raster's few cuts.
    from pyspark.sql import Window

    own, all_, order = Window.partitionBy("section"), Window.partitionBy(), Window.partitionBy("section").orderBy("j")
    got = got.withColumn("lo", F.min("v").over(own)).withColumn("hi", F.max("v").over(own))
    lo, hi = (F.min("v").over(all_), F.max("v").over(all_)) if shared else (F.col("lo"), F.col("hi"))
    got = got.withColumn("base", lo).withColumn("top", hi)
    relief = F.col("top") - F.col("base")
    got = got.withColumn("exaggeration", F.when(relief > 0, F.lit(float(height)) / relief).otherwise(F.lit(0.0)))
    starts = F.when(F.col("v").isNotNull() & F.lag("v").over(order).isNull(), 1).otherwise(0)
    got = got.withColumn("starts", starts).withColumn("run", F.when(F.col("v").isNotNull(), F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    rise = (F.col("v") - F.col("base")) * F.col("exaggeration")
    if across:
        px, py = frame.origin_x + F.col("t") * frame.width, frame.south + (1 - F.col("f")) * frame.height + rise
    else:
        px, py = frame.origin_x + F.col("f") * frame.width + rise, frame.south + (1 - F.col("t")) * frame.height
    label = F.char((F.lit(65) + (F.col("section") - 1) % 26).cast("long"))
    measured = F.col("v").isNotNull()
    return got.select("section", label.alias("label"), "j", "t", "v", F.when(measured, px).alias("x"), F.when(measured, py).alias("y"), "run", "exaggeration", "lo", "hi")
