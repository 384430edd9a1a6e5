"""The drawing: paths (layer, kind, sheet, furniture, closed, pts) and circles (layer, kind, sheet, x, y, radius), in sheet mm."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.functions import shapes
from maploom.functions.colour import CUTS
from maploom.functions.frames import Sheet
from maploom.functions.scales import nice_step

PATHS = "layer string, kind string, sheet string, furniture boolean, closed boolean, pts " + shapes.POINTS
CIRCLES = "layer string, kind string, sheet string, x double, y double, radius double"


def as_paths(df: DataFrame, layer: str | Column, kind: str, sheet: str | None = None, closed: str | bool = False, furniture: bool = False) -> DataFrame:
    """Strokes (pts, ...) as paths of a drawing."""
    shut = F.col(closed) if isinstance(closed, str) else F.lit(closed)
    return df.select((F.lit(layer) if isinstance(layer, str) else layer).alias("layer"), F.lit(kind).alias("kind"), F.lit(sheet).cast("string").alias("sheet"), F.lit(furniture).alias("furniture"), shut.alias("closed"), "pts")


def as_circles(df: DataFrame, layer: str, kind: str, sheet: str | None = None) -> DataFrame:
    return df.select(F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), F.lit(sheet).cast("string").alias("sheet"), "x", "y", "radius")


def totals(paths: DataFrame, circles: DataFrame) -> DataFrame:
    """layer, paths, circles, vertices, run_mm by pass, and in a row with a null layer for the whole drawing."""
    p = paths.select("layer", F.lit(1).alias("p"), F.lit(0).alias("c"), F.size("pts").alias("v"), shapes.path_length(F.col("pts"), F.col("closed")).alias("mm"))
    c = circles.select("layer", F.lit(0).alias("p"), F.lit(1).alias("c"), F.lit(0).alias("v"), (2 * math.pi * F.col("radius")).alias("mm"))
    return p.unionByName(c).rollup("layer").agg(F.sum("p").alias("paths"), F.sum("c").alias("circles"), F.sum("v").alias("vertices"), F.sum("mm").alias("run_mm"))


def sheets(paths: DataFrame, circles: DataFrame) -> DataFrame:
    """sheet, ord: the material sheets that are used, the surface first."""
    every = paths.select("sheet").unionByName(circles.select("sheet")).select(F.coalesce("sheet", F.lit("surface")).alias("sheet")).distinct()
    return every.select("sheet", F.when(F.col("sheet") == "surface", 0).otherwise(1).alias("ord"))


def of_sheet(rows: DataFrame, sheet: str | None) -> DataFrame:
    return rows if sheet is None else rows.where(F.coalesce("sheet", F.lit("surface")) == sheet)


def cuts_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("layer").isin(*CUTS))


def scale_bar(sheet: Sheet, target: float = 50) -> dict:
    """metres, mm, label and the rings of a bar near the target length."""
    metres = nice_step(target / sheet.mm_per_unit)
    mm = metres * sheet.mm_per_unit
    x, y, thick = sheet.margin, sheet.margin / 2, 1.8
    box = lambda a, b, w, h: [(a, b), (a + w, b), (a + w, b + h), (a, b + h)]
    plain = lambda v: f"{v:.6f}".rstrip("0").rstrip(".")
    label = f"{plain(metres / 1000)} KM" if metres >= 1000 else f"{plain(metres)} M"
    return {"metres": metres, "mm": mm, "label": label, "rings": [box(x, y, 0.45, thick), box(x, y, mm / 2, thick / 3), box(x + mm / 2, y, mm / 2, thick)]}


def north_point(x: float, y: float, r: float = 5) -> dict:
    """The ring, the needle and the pivot of a north point, and the height of its letter."""
    circle = lambda cx, cy, q: [(cx + q * math.cos(2 * math.pi * k / 32), cy + q * math.sin(2 * math.pi * k / 32)) for k in range(32)]
    needle = [(x, y + r * 0.763), (x + r * 0.137, y - r * 0.289), (x - r * 0.137, y - r * 0.289)]
    return {"ring": circle(x, y, r), "needle": needle, "pivot": circle(x, y - r * 0.158, r * 0.084), "label_y": y + r * 1.32}


def seek(width: float, height: float, w: float, h: float, free, corner: str = "se") -> tuple[float, float] | None:
    """The first of 8 x 8 places, from a corner inwards, at which free(x, y, w, h) holds."""
    for j in range(8):
        for i in range(8):
            dx, dy = i * (width - w) / 8, j * (height - h) / 8
            x = width - w - dx if "e" in corner else dx
            y = dy if "s" in corner else height - h - dy
            if free(x, y, w, h):
                return x, y
    return None
