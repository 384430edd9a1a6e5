"""Regions above a threshold: connected cells, their figures, and their outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maploom.functions import shapes
from maploom.functions.frames import Frame
from maploom.operators import kernels
from maploom.operators.contours import chain, march, to_map
from maploom.operators.focal import padded_below
from maploom.operators.graph import components, numbered
from maploom.operators.paths import per_path
from maploom.plans.storage import stored


def label_cells(cells: DataFrame, threshold: float, ncols: int) -> DataFrame:
    """r, c, z, region: the 4-connected cells above the threshold; region is the least cell number r * ncols + c in it.

    Cells of a row that touch are one run first, so only runs and the contacts between rows take part in the
    iteration, not cells.
    """
    number = F.col("r").cast("long") * ncols + F.col("c")
    high = cells.where(F.col("z") > threshold).select("r", "c", "z", number.alias("i"))
    row = Window.partitionBy("r").orderBy("c")
    # Cells of a run have the same difference of column and rank.
    high = high.withColumn("k", F.col("c") - F.row_number().over(row))
    high = stored(high.withColumn("run", F.min("i").over(Window.partitionBy("r", "k"))).drop("k"), "runs")
    below = high.select((F.col("r") - 1).alias("r"), "c", F.col("run").alias("b"))
    links = high.join(below, ["r", "c"]).select(F.col("run").alias("a"), "b").distinct()
    roots = components(links)
    return high.join(roots, high.run == roots.node, "left").select("r", "c", "z", F.coalesce("root", "run").alias("region"))


def regions(cells: DataFrame, frame: Frame, threshold: float, min_area: float = 0) -> DataFrame:
    """n, region, cells, area, total, mean, max, x, y: one row a region, numbered in reading order; total is the sum of its values,
    x, y the cell with the greatest value, of equal ones the first in reading order. Regions of fewer cells than min_area asks for are left out."""
    least = max(1, int(min_area / frame.cell**2 + 0.5))
    number = F.col("r").cast("long") * frame.ncols + F.col("c")
    best = F.max_by(F.struct("r", "c"), F.struct(F.col("z"), -number))
    by = label_cells(cells, threshold, frame.ncols).groupBy("region").agg(F.count("*").alias("cells"), F.sum(F.col("z").cast("double")).alias("total"), F.avg("z").alias("mean"), F.max("z").alias("max"), best.alias("at")).where(F.col("cells") >= least)
    return numbered(by, "n", "region").select("n", "region", "cells", (F.col("cells") * frame.cell**2).alias("area"), "total", "mean", "max", frame.easting(F.col("at.c")).alias("x"), frame.northing(F.col("at.r")).alias("y"))


def region_summary(found: DataFrame) -> DataFrame:
    """regions, area, and the mean of all their cells; sums of single-precision values are exact in any order, products with means are not."""
    return found.agg(F.count("*").alias("regions"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), (F.sum("total") / F.sum("cells")).alias("mean"))


def region_rings(cells: DataFrame, frame: Frame, threshold: float, min_area: float = 0) -> DataFrame:
    """path, pts, hole, area in map units: the outlines at the threshold, counter-clockwise around high ground.

    Slivers under half a cell go; with a minimum area, outer rings under half of it go too, holes stay.
    """
    grid = padded_below(cells, frame.nrows, frame.ncols, threshold).select((F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c"), "z")
    paths = chain(march(grid, frame.ncols + 2, levels=[threshold]))
    # Cut and measured in cells from the corner, where the numbers are small, and then put on the map, which turns y over.
    box = (0.0, 0.0, float(frame.ncols), float(frame.nrows))
    rings = paths.where("closed").select(F.col("path.lo").alias("lo"), F.col("path.hi").alias("hi"), F.transform("pts", lambda p: shapes.point(p["x"] - 1, p["y"] - 1)).alias("pts"))
    rings = per_path(rings, ["lo", "hi"], "pts " + shapes.POINTS, lambda p, closed, row: ((q,) for q in kernels.clip_ring(p, *box)))
    rings = rings.select(F.struct("lo", "hi").alias("path"), "pts").withColumn("area", shapes.ring_area2(F.col("pts")) * (-(frame.cell**2) / 2))
    rings = to_map(rings.where(F.abs("area") >= frame.cell**2 / 2), frame)
    rings = rings.select("path", "pts", (F.col("area") < 0).alias("hole"), "area")
    if min_area > 0:
        least = max(1, int(min_area / frame.cell**2 + 0.5)) * frame.cell**2
        rings = rings.where(F.col("hole") | (F.abs("area") >= least * 0.5))
    return rings


