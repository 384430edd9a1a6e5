"""Water on a raster: depressions filled, flow accumulated, wetness."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.operators.focal import _whole, gradient, neighbours
from maploom.plans.storage import stored

#: Rows and columns of a tile: what one task holds. Larger rasters have more tiles, not another way.
TILE = 2048
#: Neighbour, row step, column step, distance in cells, contour length in cells.
DIRECTIONS = (("n", -1, 0, 1.0, 0.5), ("s", 1, 0, 1.0, 0.5), ("w", 0, -1, 1.0, 0.5), ("e", 0, 1, 1.0, 0.5),
              ("nw", -1, -1, math.sqrt(2), 0.354), ("ne", -1, 1, math.sqrt(2), 0.354), ("sw", 1, -1, math.sqrt(2), 0.354), ("se", 1, 1, math.sqrt(2), 0.354))


# ---------------------------------------------------------------- tiles

_KEYS = ["raster", "tr", "tc"]


def _dealt(rows: DataFrame, tile: int, *more: str) -> DataFrame:
    """rows (raster, r, c, ...) with the tiles tr, tc that hold or border them: a cell on a tile's edge goes to its neighbours too."""
    near = lambda x: F.array_distinct(F.array(*[F.floor((F.col(x) + d) / tile).cast("int") for d in (-1, 0, 1)]))
    rows = rows.select("raster", "r", "c", *more, F.explode(near("r")).alias("tr"), near("c").alias("_tc"))
    return rows.select("raster", "r", "c", *more, "tr", F.explode("_tc").alias("tc"))


def _tiles(cells: DataFrame, value: str, tile: int) -> DataFrame:
    """raster, tr, tc, r0, c0, nr, nc, grid: a row a tile, its cells row by row with one more on each side, nan where nothing is
    measured. Tiles within a raster's extent are there even if they have no cell."""
    kind = cells.schema["raster"].dataType.simpleString()
    rows = cells.select("raster", "r", "c", F.col(value).cast("double").alias("z"))
    b = rows.groupBy("raster").agg(F.min("r").alias("ra"), F.max("r").alias("rb"), F.min("c").alias("ca"), F.max("c").alias("cb"))
    steps = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile).cast("int"), F.floor(F.col(hi) / tile).cast("int")))
    frames = b.select("*", steps("ra", "rb").alias("tr")).select("*", steps("ca", "cb").alias("tc"))
    edge = lambda lo, hi, t: (F.greatest(F.col(lo), F.col(t) * tile).cast("int"), F.least(F.col(hi), F.col(t) * tile + (tile - 1)).cast("int"))
    (r0, r1), (c0, c1) = edge("ra", "rb", "tr"), edge("ca", "cb", "tc")
    frames = frames.select(*_KEYS, F.struct(r0.alias("r0"), c0.alias("c0"), (r1 - r0 + 1).alias("nr"), (c1 - c0 + 1).alias("nc")).alias("f"), *[F.lit(None).cast(k).alias(n) for n, k in (("r", "int"), ("c", "int"), ("z", "double"))])
    dealt = _dealt(rows, tile, "z").select(*_KEYS, F.lit(None).cast(frames.schema["f"].dataType).alias("f"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "z")

    def grid(rows: pd.DataFrame) -> pd.DataFrame:
        held = rows["f"].dropna()
        if not len(held):  # beyond the raster's extent
            return pd.DataFrame(columns=names)
        r0, c0, nr, nc = (int(held.iloc[0][k]) for k in ("r0", "c0", "nr", "nc"))
        out = np.full((nr + 2, nc + 2), np.nan)
        some = rows[rows["r"].notna()]
        r, c = some["r"].to_numpy(dtype=np.int64) - r0 + 1, some["c"].to_numpy(dtype=np.int64) - c0 + 1
        ok = (r >= 0) & (r < nr + 2) & (c >= 0) & (c < nc + 2)
        out[r[ok], c[ok]] = some["z"].to_numpy(dtype=float, na_value=np.nan)[ok]
        return pd.DataFrame([(*(rows[k].iloc[0] for k in _KEYS), r0, c0, nr, nc, out.tobytes())], columns=names)

    names = [*_KEYS, "r0", "c0", "nr", "nc", "grid"]
    return frames.unionByName(dealt).groupBy(*_KEYS).applyInPandas(grid, f"raster {kind}, tr int, tc int, r0 int, c0 int, nr int, nc int, grid binary")


def _on_tiles(tiles: DataFrame, schema: str, fn) -> DataFrame:
    """The rows that fn(grid with a margin, r0, c0, halo values by (r, c)) gives for each tile, an iterator of tables."""
    kind = tiles.schema["raster"].dataType.simpleString()

    def run(parts):
        for part in parts:
            for row in part.itertuples(index=False):
                z = np.frombuffer(row.grid).reshape(row.nr + 2, row.nc + 2)
                halo = {} if row.halo is None else {(h["r"], h["c"]): h["v"] for h in row.halo}
                out = fn(z, row.r0, row.c0, halo)
                for i, k in enumerate(_KEYS):
                    out.insert(i, k, getattr(row, k))
                yield out

    return tiles.mapInPandas(run, f"raster {kind}, tr int, tc int, {schema}")


def _with_halo(tiles: DataFrame, values: DataFrame) -> DataFrame:
    """The tiles that values (raster, tr, tc, r, c, v) speak of, with these, a margin's worth at most."""
    return tiles.join(values.groupBy(*_KEYS).agg(F.collect_list(F.struct("r", "c", "v")).alias("halo")), _KEYS)


# ---------------------------------------------------------------- depressions


def filled_grid(z: np.ndarray, halo: dict[tuple[int, int], float] | None = None) -> np.ndarray:
    """The lowest surface not below z from which every cell drains to unmeasured ground or to a margin cell, whose own surface
    halo gives. The outermost cells of z are the margin; inf where nothing drains yet."""
    halo = halo or {}
    nr, nc = z.shape
    solid = ~np.isnan(z)
    inner = np.zeros(z.shape, bool)
    inner[1:-1, 1:-1] = True
    open_ = np.zeros(z.shape, bool)
    hole = np.pad(~solid, 1, constant_values=True)
    for dr in (0, 1, 2):
        for dc in (0, 1, 2):
            open_ |= hole[dr : dr + nr, dc : dc + nc]
    wide, todo = nc, (solid & inner).ravel().tolist()
    ground, out = z.ravel().tolist(), np.where(solid & inner, np.inf, np.nan).ravel()
    heap = [(ground[i], i) for i in np.flatnonzero((open_ & solid & inner).ravel()).tolist()] + [(v, r * wide + c) for (r, c), v in halo.items() if np.isfinite(v)]
    for _, i in heap:
        todo[i] = False
    heapq.heapify(heap)
    steps = (-wide - 1, -wide, -wide + 1, -1, 1, wide - 1, wide, wide + 1)
    last = nr * wide
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        v, i = pop(heap)
        if v < out[i]:
            out[i] = v
        for d in steps:
            j = i + d
            if 0 <= j < last and todo[j]:
                todo[j] = False
                push(heap, (ground[j] if ground[j] > v else v, j))
    return out.reshape(z.shape)


def fill_depressions(cells: DataFrame, tile: int = TILE, max_rounds: int = 10_000) -> DataFrame:
    """raster, r, c, filled of cells (raster, r, c, z), null where z is; cells without a row inside a raster get one.

    Each tile is flooded from its open cells and from what its neighbours' edges are known to drain at; tiles whose surroundings
    sank are flooded again, until none does. The rounds are as many as tiles that water crosses, and a raster of one tile has one.
    """
    tiles = stored(_tiles(cells, "z", tile), "tiles")
    kind = cells.schema["raster"].dataType.simpleString()

    def flood(z, r0, c0, halo):
        w = filled_grid(z, {(r - r0 + 1, c - c0 + 1): v for (r, c), v in halo.items()})
        return pd.DataFrame({"r0": [r0], "c0": [c0], "nr": [z.shape[0] - 2], "nc": [z.shape[1] - 2], "grid": [w[1:-1, 1:-1].tobytes()]})

    def edges(parts):
        for part in parts:
            for row in part.itertuples(index=False):
                w = np.frombuffer(row.grid).reshape(row.nr, row.nc)
                rim = np.ones(w.shape, bool)
                rim[1:-1, 1:-1] = False
                r, c = np.nonzero(rim & np.isfinite(w))
                yield pd.DataFrame({"raster": row.raster, "r": (r + row.r0).astype(np.int32), "c": (c + row.c0).astype(np.int32), "v": w[r, c], "fr": row.tr, "fc": row.tc})

    shape = "r0 int, c0 int, nr int, nc int, grid binary"
    done = [stored(_on_tiles(tiles.withColumn("halo", F.lit(None).cast("array<struct<r: int, c: int, v: double>>")), shape, flood), "flooded")]
    known = None
    for _ in range(max_rounds):
        rims = done[-1].mapInPandas(edges, f"raster {kind}, r int, c int, v double, fr int, fc int")
        sent = _dealt(rims, tile, "v", "fr", "fc").where("tr != fr or tc != fc").select(*_KEYS, "r", "c", "v")
        if known is not None:
            was = known.select(*_KEYS, "r", "c", F.col("v").alias("was"))
            sent = sent.join(was, [*_KEYS, "r", "c"], "left").where("was is null or v < was").drop("was")
        news = stored(sent, "rims")
        changed = news.select(*_KEYS).distinct()
        # Tiles beyond a raster's extent don't count.
        if not changed.join(tiles.select(*_KEYS), _KEYS, "left_semi").limit(1).count():
            break
        known = stored((news if known is None else known.unionByName(news)).groupBy(*_KEYS, "r", "c").agg(F.min("v").alias("v")), "known")
        done.append(stored(_on_tiles(_with_halo(tiles, known.join(changed, _KEYS, "left_semi")), shape, flood), "flooded"))
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")

    def out(parts):
        for part in parts:
            for row in part.itertuples(index=False):
                r, c = np.divmod(np.arange(row.nr * row.nc), row.nc)
                yield pd.DataFrame({"raster": row.raster, "r": (r + row.r0).astype(np.int32), "c": (c + row.c0).astype(np.int32), "filled": np.frombuffer(row.grid)})

    last = done[0]
    if len(done) > 1:
        # A tile's last flood counts; tiles are told apart before their grids move.
        every = [d.withColumn("round", F.lit(i)) for i, d in enumerate(done)]
        final = stored(_union(every).groupBy(*_KEYS).agg(F.max("round").alias("round")), "last")
        last = _union(every).join(final, [*_KEYS, "round"], "left_semi")
    return last.mapInPandas(out, f"raster {kind}, r int, c int, filled double").withColumn("filled", F.when(~F.isnan("filled"), F.col("filled")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flow_shares(cells: DataFrame, cell: float, p: float = 1.1, value: str = "filled") -> DataFrame:
    """raster, r, c, to_r, to_c, share: how a cell's water parts among its lower neighbours, by gradient to the power p and contour length.

    Every cell needs its row, the unmeasured ones too: diagonal neighbours are found through the cell above or below.
    """
    rows = neighbours(cells, ["raster"], value)
    weight = lambda n, far, wide: F.when(F.col(n) < F.col("z"), F.pow((F.col("z").cast("double") - F.col(n)) / (far * cell), F.lit(p)) * wide)
    out = F.array(*[F.struct((F.col("r") + dr).alias("to_r"), (F.col("c") + dc).alias("to_c"), weight(n, far, wide).alias("w")) for n, dr, dc, far, wide in DIRECTIONS])
    rows = rows.where("z is not null").withColumn("o", F.filter(out, lambda x: x["w"].isNotNull())).withColumn("total", F.aggregate("o", F.lit(0.0), lambda s, x: s + x["w"]))
    return rows.select("raster", "r", "c", F.explode("o").alias("o"), "total").select("raster", "r", "c", "o.to_r", "o.to_c", (F.col("o.w") / F.col("total")).alias("share"))


def accumulated_grid(filled: np.ndarray, start: np.ndarray, cell: float, p: float = 1.1) -> np.ndarray:
    """What drains through each cell of start, its own included, from the highest cell down. The outermost cells are the
    margin: they take and don't give."""
    nr, nc = filled.shape
    inner = filled[1:-1, 1:-1]
    parts = np.zeros((len(DIRECTIONS), *inner.shape))
    for k, (_, dr, dc, far, wide) in enumerate(DIRECTIONS):
        drop = (inner - filled[1 + dr : nr - 1 + dr, 1 + dc : nc - 1 + dc]) / (far * cell)
        down = drop > 0
        parts[k][down] = drop[down] ** p * wide
    total = parts.sum(axis=0)
    parts /= np.where(total > 0, total, 1)
    area = start.ravel().tolist()
    steps = [dr * nc + dc for _, dr, dc, _, _ in DIRECTIONS]
    flat = inner.ravel()
    order = np.argsort(-np.where(np.isnan(flat), -np.inf, flat), kind="stable")
    order = order[total.ravel()[order] > 0]
    parts = parts.reshape(len(DIRECTIONS), -1)
    # Some cells at a time become Python numbers.
    for at in range(0, len(order), 1 << 16):
        some = order[at : at + (1 << 16)]
        r, c = np.divmod(some, nc - 2)
        for i, row in zip(((r + 1) * nc + c + 1).tolist(), parts[:, some].T.tolist(), strict=True):
            if a := area[i]:
                for d, x in zip(steps, row, strict=True):
                    if x:
                        area[i + d] += a * x
    return np.array(area).reshape(filled.shape)


def accumulate(filled: DataFrame, cell: float, p: float = 1.1, tile: int = TILE, max_rounds: int = 100_000) -> DataFrame:
    """raster, r, c, area over filled (raster, r, c, filled): the area that drains through each measured cell.

    Each tile passes its own cells' water down; what leaves it enters its neighbours in the next round, and so on until
    none leaves any. The surface falls all the way, so water enters a tile a bounded number of times; one tile takes one round.
    """
    tiles = stored(_tiles(filled, "filled", tile), "tiles")

    def pass_down(first: bool):
        def run(z, r0, c0, halo):
            start = np.zeros(z.shape)
            if first:
                start[1:-1, 1:-1] = np.where(np.isnan(z[1:-1, 1:-1]), 0, cell * cell)
            for (r, c), v in halo.items():
                start[r - r0 + 1, c - c0 + 1] += v
            area = accumulated_grid(z, start, cell, p)
            r, c = np.nonzero(area)
            inside = (r > 0) & (r < z.shape[0] - 1) & (c > 0) & (c < z.shape[1] - 1)
            return pd.DataFrame({"r": (r + r0 - 1).astype(np.int32), "c": (c + c0 - 1).astype(np.int32), "area": area[r, c], "inside": inside})

        return run

    schema = "r int, c int, area double, inside boolean"
    moved = stored(_on_tiles(tiles.withColumn("halo", F.lit(None).cast("array<struct<r: int, c: int, v: double>>")), schema, pass_down(True)), "areas")
    every = [moved]
    for _ in range(max_rounds):
        left = moved.where("not inside").select("raster", F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc"), "r", "c", F.col("area").alias("v"))
        left = left.groupBy(*_KEYS, "r", "c").agg(F.sum("v").alias("v"))
        if not moved.where("not inside").limit(1).count():
            sums = _union([e.where("inside").select("raster", "r", "c", "area") for e in every])
            return sums if len(every) == 1 else sums.groupBy("raster", "r", "c").agg(F.sum("area").alias("area"))
        moved = stored(_on_tiles(_with_halo(tiles, left), schema, pass_down(False)), "areas")
        every.append(moved)
        if len(every) > 64:
            sums = _union([e.where("inside") for e in every]).groupBy("raster", "r", "c", "inside").agg(F.sum("area").alias("area"))
            every = [stored(sums, "areas")]
    raise RuntimeError("water still moves; the surface has a cycle")


def wetness_of(cells: DataFrame, area: DataFrame, cell: float, min_slope: float = 0.001) -> DataFrame:
    """raster, r, c, v: ln of the area per contour width over the tangent of the slope; the slope is that of the unfilled cells."""
    dx, dy = gradient(cell)
    tan = neighbours(cells, ["raster"]).where(_whole()).select("raster", "r", "c", F.greatest(F.hypot(dx, dy), F.lit(min_slope)).alias("tan"))
    return tan.join(area, ["raster", "r", "c"]).select("raster", "r", "c", F.log(F.col("area") / cell / F.col("tan")).alias("v"))


def wetness(cells: DataFrame, cell: float, min_slope: float = 0.001, p: float = 1.1) -> DataFrame:
    """wetness_of with the areas of the filled surface."""
    return wetness_of(cells, accumulate(stored(fill_depressions(cells), "filled"), cell, p), cell, min_slope)


def water_left(area: DataFrame, filled: DataFrame, cell: float) -> Column:
    """For checks: what reaches cells without a lower neighbour must be all that fell."""
    sinks = filled.where("filled is not null").join(flow_shares(filled, cell).select("raster", "r", "c").distinct(), ["raster", "r", "c"], "left_anti")
    return sinks.join(area, ["raster", "r", "c"]).agg(F.sum("area")).first()[0]
