"""3x3 windows over cells (r, c, z), null where nothing was measured.

Two window passes, along rows and then along columns, give every cell its eight neighbours: two shuffles of the
cells, instead of nine copies of each. Cells beyond the edge are null like unmeasured ones; inside, each cell has its row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = (("nw", "n", "ne"), ("w", "z", "e"), ("sw", "s", "se"))
AROUND = ("nw", "n", "ne", "w", "e", "sw", "s", "se")


def neighbours(cells: DataFrame, keys: Sequence[str] = (), value: str = "z") -> DataFrame:
    """keys, r, c and the nine values; r grows to the south."""
    along = Window.partitionBy(*keys, "r").orderBy("c")
    across = Window.partitionBy(*keys, "c").orderBy("r")
    side = lambda n: F.when(F.lag("c", n).over(along) == F.col("c") - n, F.lag(value, n).over(along))
    rows = cells.select(*keys, "r", "c", side(1).alias("w"), F.col(value).alias("z"), side(-1).alias("e"))
    trio = F.struct("w", "z", "e")
    beyond = lambda n: F.when(F.lag("r", n).over(across) == F.col("r") - n, F.lag(trio, n).over(across))
    rows = rows.withColumn("up", beyond(1)).withColumn("down", beyond(-1))
    return rows.select(*keys, "r", "c", F.col("up.w").alias("nw"), F.col("up.z").alias("n"), F.col("up.e").alias("ne"), "w", "z", "e", F.col("down.w").alias("sw"), F.col("down.z").alias("s"), F.col("down.e").alias("se"))


def _whole() -> Column:
    out = F.col("z").isNotNull()
    for n in AROUND:
        out = out & F.col(n).isNotNull()
    return out


def gradient(cell: float) -> tuple[Column, Column]:
    """Horn's (dz/dx, dz/dy), y growing with r."""
    n = {k: F.col(k).cast("double") for k in AROUND}
    dx = ((n["ne"] + 2 * n["e"] + n["se"]) - (n["nw"] + 2 * n["w"] + n["sw"])) / (8 * cell)
    dy = ((n["sw"] + 2 * n["s"] + n["se"]) - (n["nw"] + 2 * n["n"] + n["ne"])) / (8 * cell)
    return dx, dy


def slope_degrees(cells: DataFrame, cell: float, keys: Sequence[str] = ()) -> DataFrame:
    """keys, r, c, v: Horn's slope; null unless all nine cells were measured."""
    dx, dy = gradient(cell)
    return neighbours(cells, keys).select(*keys, "r", "c", F.when(_whole(), F.atan(F.hypot(dx, dy)) * (180 / math.pi)).alias("v"))


def ruggedness(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The root of the summed squares of the eight differences."""
    total = F.lit(0.0)
    for n in AROUND:
        d = F.col(n).cast("double") - F.col("z")
        total = total + d * d
    return neighbours(cells, keys).select(*keys, "r", "c", F.when(_whole(), F.sqrt(total)).alias("v"))


def roughness(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The greatest of the nine values less the least."""
    every = [F.col(n) for n in (*AROUND, "z")]
    return neighbours(cells, keys).select(*keys, "r", "c", F.when(_whole(), F.greatest(*every) - F.least(*every)).alias("v"))


def quads(cells: DataFrame, keys: Sequence[str] = (), value: str = "z") -> DataFrame:
    """keys, r, c of each north-west corner with the square's values a b / d e; squares lacking a corner cell are left out."""
    along = Window.partitionBy(*keys, "r").orderBy("c")
    across = Window.partitionBy(*keys, "c").orderBy("r")
    rows = cells.select(*keys, "r", "c", F.col(value).alias("a"), F.lead(value).over(along).alias("b"), (F.lead("c").over(along) == F.col("c") + 1).alias("right"))
    rows = rows.withColumn("below", F.when(F.lead("r").over(across) == F.col("r") + 1, F.lead(F.struct("a", "b")).over(across)))
    return rows.where("right and below is not null").select(*keys, "r", "c", "a", "b", F.col("below.a").alias("d"), F.col("below.b").alias("e"))


def padded_by_edge(cells: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """One more ring of cells that repeats the edge, rows and columns from -1 to nrows and ncols."""
    def ends(name: str, last: int) -> Column:
        same = F.array(F.col(name))
        same = F.when(F.col(name) == 0, F.concat(F.array(F.col(name) - 1), same)).otherwise(same)
        return F.when(F.col(name) == last, F.concat(same, F.array(F.col(name) + 1))).otherwise(same)

    wide = cells.select("r", F.explode(ends("c", ncols - 1)).alias("c"), "z")
    return wide.select(F.explode(ends("r", nrows - 1)).alias("r"), "c", "z")


def padded_below(cells: DataFrame, nrows: int, ncols: int, threshold: float) -> DataFrame:
    """One more ring of cells below the threshold; unmeasured cells get the same value."""
    pad = threshold - max(1.0, abs(threshold) * 0.5)
    spark = cells.sparkSession
    whole = spark.range(-1, ncols + 1).select(F.col("id").cast("int").alias("c"))
    sides = spark.range(0, nrows).select(F.col("id").cast("int").alias("r"), F.explode(F.array(F.lit(-1), F.lit(ncols))).alias("c"))
    ring = whole.select(F.explode(F.array(F.lit(-1), F.lit(nrows))).alias("r"), "c").unionByName(sides)
    inner = cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.coalesce(F.col("z").cast("double"), F.lit(pad)).alias("z"))
    return inner.unionByName(ring.withColumn("z", F.lit(pad)))


def difference(a: DataFrame, b: DataFrame, absolute: bool = False) -> DataFrame:
    """r, c, z of a less b; null where either is."""
    d = F.col("a.z").cast("double") - F.col("b.z")
    return a.alias("a").join(b.alias("b"), ["r", "c"]).select("r", "c", (F.abs(d) if absolute else d).alias("z"))


def check_aligned(a, b) -> None:
    """Raises unless two frames have the same size, cell and origin."""
    if (a.nrows, a.ncols) != (b.nrows, b.ncols):
        raise ValueError(f"the rasters are of different sizes: {a.ncols} x {a.nrows} and {b.ncols} x {b.nrows}")
    if abs(a.cell - b.cell) > 1e-9 or abs(a.origin_x - b.origin_x) > a.cell * 0.01 or abs(a.origin_y - b.origin_y) > a.cell * 0.01:
        raise ValueError("the rasters are not on the same grid")


def stats(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """lo, hi, relief over the measured cells, how many those are, and how many cells there are; null if none."""
    return cells.groupBy(*keys).agg(F.min("z").alias("lo"), F.max("z").alias("hi"), (F.max("z") - F.min("z")).alias("relief"), F.count("z").alias("measured"), F.count("*").alias("total"))
