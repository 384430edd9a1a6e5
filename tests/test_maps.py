"""Operators against plain versions and known shapes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maploom.functions.frames import Frame, Sheet, fit_scale, from_utm, to_utm
from maploom.functions import shapes
from maploom.functions.colour import refuse_restricted
from maploom.operators import contours, features, fills, flow, focal, kernels, lettering, paths, regions, symbols
from maploom.plans import queries
from maploom.plans.compile import Inputs, compile_drawing, merged
from maploom.plans.fixtures import synthetic
from maploom.streaming import arrivals

CONE = Frame(129, 129, 1.0, 0.0, 129.0)


def cone(spark, hole=None):
    z = lambda c, r: 40 - 0.5 * F.hypot(c - 64, r - 64)
    return synthetic(spark, 129, 129, (lambda c, r: F.when(F.hypot(c - 64, r - 64) >= hole, z(c, r))) if hole else z)


def table(spark, grid, name="z"):
    rows = [(1, r, c, None if math.isnan(v) else float(v)) for r, row in enumerate(grid) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, f"raster int, r int, c int, {name} double")


def test_cone_contours(spark):
    got = contours.trace(cone(spark), CONE, 2.0, 0.0, 40.0, 5).where("level between 12 and 38").collect()
    assert len({r.level for r in got}) == len(got) == 14 and all(r.closed for r in got)
    for r in got:
        p = np.array([(q.x, q.y) for q in r.pts])
        assert kernels.area2(p) > 0
        assert kernels.run_length(kernels.closed_up(p)) == pytest.approx(2 * math.pi * (40 - r.level) * 2, rel=0.01)
        assert r["index"] == (r.level % 10 == 0)


def test_contours_keep_off_holes_and_reach_edges(spark):
    got = contours.trace(cone(spark, 8), CONE, 2.0, 0.0, 40.0)
    xs = got.select(F.explode("pts").alias("p")).select(F.min(F.hypot(F.col("p.x") - 64.5, F.col("p.y") - 64.5))).first()[0]
    assert xs > 6.5
    ramp = synthetic(spark, 40, 40, lambda c, r: 50 + 0.7 * c + 0.4 * r)
    frame = Frame(40, 40, 2.0)
    pts = contours.trace(ramp, frame, 1.0, 50.0, 93.0).select(F.explode("pts").alias("p")).agg(F.min("p.x"), F.max("p.x"), F.min("p.y"), F.max("p.y")).first()
    assert tuple(pts) == pytest.approx((0, 80, 0, 80))
    pad = synthetic(spark, 41, 41, lambda c, r: F.when((F.abs(c - 20) < 5) & (F.abs(r - 20) < 5), 10.0).otherwise(6.0))
    assert contours.chain(contours.march(pad, 41, levels=[10.0])).count() == 0


def test_chaining_by_joins_is_the_same(spark):
    seg = contours.march(cone(spark, 8), 129, 3.0, lo=0.0, hi=40.0)
    key = lambda df: sorted((r.level, r.closed, len(r.pts), round(kernels.run_length(np.array([(p.x, p.y) for p in r.pts])), 6), tuple(r.path)) for r in df.collect())
    assert key(contours.chain(seg)) == key(contours.chain(seg, block=7)) == key(contours.chain(seg, block=1))


def test_focal_values(spark):
    ramp = synthetic(spark, 9, 9, lambda c, r: c)
    assert {round(r.v, 9) for r in focal.ruggedness(ramp).where("v is not null").collect()} == {round(math.sqrt(6), 9)}
    assert {r.v for r in focal.roughness(ramp).where("v is not null").collect()} == {2.0}
    assert {round(r.v, 6) for r in focal.slope_degrees(synthetic(spark, 9, 9, lambda c, r: c / 2), 1.0).where("v is not null").collect()} == {26.565051}
    assert focal.slope_degrees(ramp, 1.0).where("v is null").count() == 81 - 49
    with pytest.raises(ValueError, match="sizes"):
        focal.check_aligned(Frame(3, 3), Frame(3, 4))
    with pytest.raises(ValueError, match="grid"):
        focal.check_aligned(Frame(3, 3), Frame(3, 3, 1.0, 5.0))


def plain_flow(z):
    """(filled, area) by relaxation, and by cells from the highest down."""
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    at = {k for k in np.ndindex(*z.shape) if not np.isnan(z[k])}
    w = {k: z[k] if any((k[0] + a, k[1] + b) not in at for a, b in near) else math.inf for k in at}
    while True:
        new = {k: min(w[k], max(z[k], min(w.get((k[0] + a, k[1] + b), math.inf) for a, b in near))) for k in at}
        if new == w:
            break
        w = new
    area = dict.fromkeys(at, 1.0)
    for r, c in sorted(at, key=lambda k: -w[k]):
        low = {(r + a, c + b): ((w[r, c] - w[r + a, c + b]) / math.hypot(a, b)) ** 1.1 * (0.354 if a and b else 0.5) for a, b in near if w.get((r + a, c + b), math.inf) < w[r, c]}
        for to, part in low.items():
            area[to] += area[r, c] * part / sum(low.values())
    return w, area


@pytest.mark.parametrize("tile", [5, 8, 512])
def test_filling_and_flow_in_tiles(spark, tile):
    """Two rasters, one with a basin that drains through many tiles, whatever the size of the tiles."""
    rng = np.random.default_rng(2)
    one = np.round(rng.random((17, 19)) * 10, 3)
    one[5, 7] = np.nan
    # A spiral wall with one way out.
    two = np.full((21, 23), 90.0)
    for i, (a, b) in enumerate([(1, 20), (1, 20)]):
        two[1 + 2 * i :: 4, a:b] = np.round(rng.random(two[1 + 2 * i :: 4, a:b].shape), 3)
    two[2::4, 19], two[4::4, 1] = 0.5, 0.5
    two[0, 0:3], two[12, 10] = 0.0, np.nan
    cells = table(spark, one).unionAll(table(spark, two).withColumn("raster", F.lit(2)).select(*table(spark, one).columns)).repartition(3)
    filled = flow.fill_depressions(cells, tile=tile)
    got = {(x.raster, x.r, x.c): x.filled for x in filled.collect()}
    area = {(x.raster, x.r, x.c): x.area for x in flow.accumulate(filled, 1.0, tile=tile).collect()}
    assert len(got) == one.size + two.size
    names = [r[0] for r in cells.groupBy("raster").count().orderBy("raster").select("raster").collect()]
    for name, z in zip(names, (one, two), strict=True):
        w, a = plain_flow(z)
        assert {k: got[name, *k] for k in np.ndindex(*z.shape)} == {k: w.get(k) for k in np.ndindex(*z.shape)}
        assert {k: area.get((name, *k)) for k in np.ndindex(*z.shape) if k in a} == pytest.approx(a)


def test_pit_is_filled(spark):
    get = lambda df, n: {(r.r, r.c): r[n] for r in df.collect()}
    pit = table(spark, [[50 + 0.1 * c if (r, c) != (10, 10) else 40.0 for c in range(21)] for r in range(21)])
    v = get(flow.fill_depressions(pit), "filled")[10, 10]
    assert 45 < v <= 51.1


def test_regions_against_flood_fill(spark):
    rng = random.Random(7)
    grid = [[rng.random() for _ in range(31)] for _ in range(23)]
    got = {r.region: (r.cells, round(r["mean"], 9), r.x, r.y) for r in regions.regions(table(spark, grid), Frame(23, 31, 1.0, 0.0, 23.0), 0.45).collect()}
    seen, want = set(), {}
    for r0 in range(23):
        for c0 in range(31):
            if (r0, c0) in seen or grid[r0][c0] <= 0.45:
                continue
            stack, part = [(r0, c0)], []
            seen.add((r0, c0))
            while stack:
                r, c = stack.pop()
                part.append((r, c))
                for q in ((r, c + 1), (r, c - 1), (r + 1, c), (r - 1, c)):
                    if 0 <= q[0] < 23 and 0 <= q[1] < 31 and q not in seen and grid[q[0]][q[1]] > 0.45:
                        seen.add(q)
                        stack.append(q)
            top = max(part, key=lambda q: grid[q[0]][q[1]])
            want[min(r * 31 + c for r, c in part)] = (len(part), round(sum(grid[r][c] for r, c in part) / len(part), 9), top[1] + 0.5, 23 - top[0] - 0.5)
    assert got == want


def test_region_rings_hold_the_area(spark):
    square = synthetic(spark, 30, 30, lambda c, r: F.when(c.between(5, 20) & r.between(5, 20) & ~(c.between(10, 14) & r.between(10, 14)), 10.0).otherwise(0.0))
    got = regions.region_rings(square, Frame(30, 30, 1.0), 5.0).collect()
    assert sorted(r.hole for r in got) == [False, True]
    assert sum(r.area for r in got) == pytest.approx(16 * 16 - 25, rel=0.1)


def test_dashes_bands_and_clips():
    line = np.array([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)])
    marks = kernels.dashes(line, False, [3, 1.5])
    assert [round(kernels.run_length(m), 6) for m in marks] == [3, 3, 3, 3, 2]
    ring = np.array([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])
    assert {round(kernels.run_length(m), 6) for m in kernels.dashes(ring, True, [3, 1.5])} == {round(40 / 9 / 4.5 * 3, 6)}
    assert kernels.dashes(line, False, None)[0] is line and kernels.dashes(line[:1], False, [1, 1]) == []
    assert kernels.band_area(kernels.band(line, 2.0, False)) == pytest.approx(40)
    assert kernels.band_area(kernels.band(ring, 2.0, True)) == pytest.approx(80)
    assert kernels.band(line, 0, False) == []
    assert kernels.clip_ring(ring, 2, -1, 5, 20)[0].tolist() == [[2, 0], [5, 0], [5, 10], [2, 10]] and kernels.clip_ring(ring, 50, 0, 60, 5) == []
    sharp = np.array([(0.0, 0.0), (10.0, 0.0), (0.0, 0.1)])
    assert np.abs(kernels.offset(sharp, 1.0, False)).max() < 14
    hole = np.array([(3.0, 3.0), (7.0, 3.0), (7.0, 7.0), (3.0, 7.0)])
    pieces = kernels.clip_to_rings(np.array([(-5.0, 5.0), (15.0, 5.0)]), False, [ring, hole])
    assert [p.tolist() for p in pieces] == [[[0, 5], [3, 5]], [[7, 5], [10, 5]]]
    parts = kernels.without_boxes(ring, True, [(5, 0, 1, 1, 0.0)])
    assert len(parts) == 1 and not parts[0][1] and kernels.run_length(parts[0][0]) == pytest.approx(38)


def test_every_pattern_stays_inside(spark):
    ring = np.array([(0.0, 0.0), (20.0, 0.0), (20.0, 12.0), (0.0, 12.0)])
    for name in ("lines", "hex", "stipple", "echo", "brick"):
        got = fills.fill(spark, [ring], name, 2.0, 20.0, 0.1).select(F.explode("pts").alias("p")).agg(F.count("*"), F.min("p.x"), F.max("p.x"), F.min("p.y"), F.max("p.y")).first()
        assert got[0] > 4 and got[1] >= -1e-6 and got[2] <= 20 + 1e-6 and got[3] >= -1e-6 and got[4] <= 12 + 1e-6
    with pytest.raises(ValueError):
        fills.fill(spark, [ring], "tartan")


def test_overlapping_features_are_filled_one_by_one(spark):
    """Two squares that overlap, one with a hole: each takes its own ink, with its own spacing."""
    from maploom.plans.compile import feature_paths

    sheet = Sheet(Frame(100, 100, 1.0, 0.0, 100.0), 1000, 0.0)
    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    rows = [(1, 0, False, square(10.0, 10.0, 40.0), 1.0), (1, 1, True, square(20.0, 20.0, 10.0)[::-1], 1.0), (2, 0, False, square(30.0, 30.0, 40.0), None)]
    table_ = spark.createDataFrame(rows, f"ord int, ring int, hole boolean, pts {shapes.POINTS}, spacing double")
    style = {"pattern": "lines", "spacing_mm": 2.0, "rotation_deg": 0, "outline": False}
    ink = lambda r: feature_paths(spark, {"kind": "polygon", "rows": r, "style": style}, sheet)[0].agg(F.sum(shapes.path_length(F.col("pts")))).first()[0]
    one, two = ink(table_.where("ord = 1")), ink(table_.where("ord = 2"))
    assert ink(table_) == pytest.approx(one + two)
    assert one == pytest.approx((40 * 40 - 10 * 10) / 1.0, rel=0.06) and two == pytest.approx(40 * 40 / 2.0, rel=0.06)


def test_furniture_registration_and_difference(spark):
    """A title, scale bar and north point inside the boundary, dowel holes through both sheets, and a difference of two rasters."""
    from maploom.plans.compile import Inputs, compile_drawing

    frame = Frame(60, 60, 1.0, 0.0, 60.0)
    cells, other = (synthetic(spark, 60, 60, lambda c, r, k=k: k * F.hypot(c - 30, r - 30)) for k in (2.0, 1.0))
    spec = {"sheet": {"title": "HILL 7", "scale": 500}, "contours": {"enabled": False}, "regions": {"enabled": True, "threshold": 5.0, "source": "difference"}, "furniture": {"enabled": True}}
    lines, rounds, sheet = compile_drawing(spark, Inputs(cells, frame, other=other), spec)
    kinds = {(r.kind, r.sheet): r.n for r in lines.groupBy("kind", "sheet").agg(F.count("*").alias("n")).collect()}
    assert kinds["furniture", None] > 6 and kinds["frame", None] == kinds["frame", "overlay"] == 1 and kinds["regions", "overlay"] >= 1
    holes = sorted((r.x, r.y, r.radius) for r in rounds.where("kind = 'registration'").collect())
    assert holes == sorted([(6.0, 6.0, 1.25), (sheet.width - 6, sheet.height - 10, 1.25)] * 2)
    box = lines.where("kind = 'furniture'").select(F.explode("pts").alias("p")).agg(F.min("p.x"), F.max("p.x"), F.min("p.y"), F.max("p.y")).first()
    assert box[0] >= 0 and box[2] >= 0 and box[1] <= sheet.width and box[3] <= sheet.height
    with pytest.raises(ValueError, match="second raster"):
        compile_drawing(spark, Inputs(cells, frame), spec)


def test_labels_leave_gaps(spark):
    lines = contours.trace(cone(spark), CONE, 2.0, 10.0, 38.0)
    placed = lettering.place_labels(lines, 2.0, ["level", "path", "closed", "pts"], 5, 2.2, 60).cache()
    assert {r.level for r in placed.where("size(boxes) > 0").collect()} == {10.0, 20.0, 30.0}
    gapped = paths.gapped(placed, "boxes", ["level"])
    assert gapped.where("level in (10, 20, 30) and closed").count() == 0 and gapped.where("level = 12 and closed").count() == 1


def test_symbols_and_hatching(spark):
    grid = synthetic(spark, 40, 40, lambda c, r: c / 39)
    a = symbols.symbol_field(grid, Frame(40, 40), 4)
    assert a.count() == 100 and a.agg(F.max("radius")).first()[0] == pytest.approx(2 * (0.08 + 0.92 * 36 / 39))
    ink = symbols.hatch_field(grid, Frame(40, 40), 0, 1, 4, 4, 0).select(F.col("ax"), (F.col("bx") - F.col("ax")).alias("l"))
    west, east = ink.where("ax < 20").agg(F.avg("l")).first()[0], ink.where("ax >= 20").agg(F.avg("l")).first()[0]
    assert east > 2 * west
    assert symbols.signed_symbol_field(grid.withColumn("z", F.lit(0.0)), Frame(40, 40)).count() == 0


def test_frames(spark):
    row = spark.range(1).select(F.lit(69.6501).alias("lat"), F.lit(18.9553).alias("lon"))
    x, y = to_utm(F.col("lat"), F.col("lon"), 34)
    got = row.select(x.alias("x"), y.alias("y")).select("x", "y", *from_utm(F.col("x"), F.col("y"), 34)).first()
    assert got[2] == pytest.approx(69.6501, abs=1e-8) and got[3] == pytest.approx(18.9553, abs=1e-8)
    assert fit_scale(Frame(100, 100), 600, 400) == 250 and fit_scale(Frame(10**7, 100), 600, 400) is None
    assert Sheet(Frame(100, 100), 200).doubt_mm() == 35
    with pytest.raises(PermissionError):
        refuse_restricted("restricted")


def test_holes_and_pairs(spark):
    sq = lambda x, y, n: [{"x": x, "y": y}, {"x": x + n, "y": y}, {"x": x + n, "y": y + n}, {"x": x, "y": y + n}]
    rows = [(0, False, sq(0.0, 0.0, 30.0)), (1, False, sq(5.0, 5.0, 15.0)), (2, True, sq(7.0, 7.0, 2.0)), (3, True, sq(100.0, 0.0, 2.0)), (4, True, sq(25.0, 25.0, 2.0))]
    got = {r.ring: r.owner for r in features.group_rings(spark.createDataFrame(rows, "ring int, hole boolean, pts array<struct<x: double, y: double>>")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 0}
    with pytest.raises(ValueError, match="attribute rows"):
        features.check_pairs(spark.range(3).withColumnRenamed("id", "ord"), spark.range(2).withColumnRenamed("id", "ord"))


def test_compile(spark):
    image = spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"), F.lit(10).alias("red"), F.lit(20).alias("green"), F.lit(30).alias("blue"))
    inputs = Inputs(cone(spark), CONE, pixels=image, image_size=(20, 20))
    spec = {"contours": {"interval": 4.0, "style": "dashed"}, "halftone": {"enabled": True, "across": 10, "licence": "restricted"}, "sections": {"enabled": True}, "hachures": {"enabled": True}, "clip": {"rings": [[(0, 0), (300, 0), (300, 645), (0, 645)]]}}
    p, c, sheet = compile_drawing(spark, inputs, spec)
    kinds = {r.kind for r in p.select("kind").distinct().collect()}
    assert {"contours", "contour-labels", "sections", "hachures", "frame"} <= kinds and c.count() > 0
    assert p.where("not furniture").select(F.explode("pts").alias("q")).agg(F.max("q.x")).first()[0] <= 300 + 1e-6
    with pytest.raises(PermissionError):
        compile_drawing(spark, inputs, spec, export=True)
    with pytest.raises(KeyError):
        merged({"contour": {}})


def test_arrivals_stream(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(1704067200 + F.col("id") * 120).alias("ts"), (F.col("id") % 40).cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    arrivals.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    whole = arrivals.by_window(rows)
    assert got.count() > 0 and got.exceptAll(whole).count() == 0


def test_flow_queries_take_the_whole_raster(spark, tmp_path):
    """More rows than forty, against the surface and the areas by plain relaxation and by cells from the highest down."""
    rng = np.random.default_rng(4)
    z = np.round(rng.normal(size=(70, 64)), 4)
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(z)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    w = np.full(z.shape, np.inf)
    w[0], w[-1], w[:, 0], w[:, -1] = z[0], z[-1], z[:, 0], z[:, -1]
    while True:
        inner = np.min([w[1 + a : 69 + a, 1 + b : 63 + b] for a, b in near], axis=0)
        new = w.copy()
        new[1:-1, 1:-1] = np.minimum(w[1:-1, 1:-1], np.maximum(z[1:-1, 1:-1], inner))
        if (new == w).all():
            break
        w = new
    got = {(r.r, r.c): r.filled for r in queries.depressions_filled(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({(r, c): w[r, c] for r in range(70) for c in range(64)}, abs=1e-6)
    area = np.ones(z.shape)
    for r, c in sorted(np.ndindex(*z.shape), key=lambda x: -w[x]):
        low = {(r + a, c + b): ((w[r, c] - w[r + a, c + b]) / np.hypot(a, b)) ** 1.1 * (0.354 if a and b else 0.5) for a, b in near if 0 <= r + a < 70 and 0 <= c + b < 64 and w[r + a, c + b] < w[r, c]}
        for to, part in low.items():
            area[to] += area[r, c] * part / sum(low.values())
    p = lambda a, b: z[1 + a : 69 + a, 1 + b : 63 + b]
    dx = (p(-1, 1) + 2 * p(0, 1) + p(1, 1) - p(-1, -1) - 2 * p(0, -1) - p(1, -1)) / 8
    dy = (p(1, -1) + 2 * p(1, 0) + p(1, 1) - p(-1, -1) - 2 * p(-1, 0) - p(-1, 1)) / 8
    v = np.log(area[1:-1, 1:-1] / np.maximum(np.hypot(dx, dy), 0.001))
    got = {(r.r, r.c): r.v for r in queries.wetness_index(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({(r + 1, c + 1): v[r, c] for r in range(68) for c in range(62)}, abs=2e-5)


def test_clip_to_rings_clips_every_path(spark, tmp_path):
    """One horizontal step a path through the first square, on ids that no tenth holds."""
    import datetime

    at = lambda h: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(hours=h)
    events = [(2 * k + j, k, at(h), 15.0) for k in (1, 2, 3, 11, 20) for j, h in enumerate((75, 225))]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(0, 1)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    # From x = 5 to 15 at y = 5: the square ends at x = 10.
    got = sorted(tuple(r) for r in queries.clip_to_rings(spark, str(tmp_path)).collect())
    assert got == [(k, 0, 0.0, 0.5) for k in (1, 2, 3, 11, 20)]


def test_points_and_fills_by_attribute(spark):
    """Sizes, turns and spacings by a field, with the fixed measure where it's missing; dashed and filled symbols."""
    from maploom.plans.compile import feature_paths

    sheet = Sheet(Frame(100, 100, 1.0, 0.0, 100.0), 1000)
    rows = spark.createDataFrame([(1, 20.0, 20.0, 0.0), (2, 50.0, 50.0, 10.0), (3, 80.0, 80.0, None), (4, 500.0, 5.0, 5.0)], "ord int, x double, y double, girth double")
    wide = lambda r: max(p.x for p in r.pts) - min(p.x for p in r.pts)
    style = {"symbol": "square", "driven": {"size": {"field": "girth", "lo": 0, "hi": 10, "least": 2, "most": 6, "mode": "linear"}}}
    drawn = feature_paths(spark, {"kind": "point", "rows": rows, "style": style}, sheet)
    assert sorted(wide(r) for r in drawn[0].collect()) == pytest.approx(sorted(2 * r / math.sqrt(2) for r in (2, 6, 2)))
    turned = {"symbol": "square", "driven": {"rotation": {"field": "girth", "offset": 45}}}
    got = feature_paths(spark, {"kind": "point", "rows": rows.where("ord in (1, 3)"), "style": turned}, sheet)
    assert sorted(wide(r) for r in got[0].collect()) == pytest.approx([2 * math.sqrt(2), 4.0])
    dashed, filled = feature_paths(spark, {"kind": "point", "rows": rows.drop("girth"), "style": {"radius_mm": 8.0, "line_type": "dashed", "pattern": "lines", "spacing_mm": 1.0}}, sheet)
    assert dashed.count() > 9 and filled.agg(F.sum(shapes.path_length(F.col("pts")))).first()[0] == pytest.approx(3 * math.pi * 64, rel=0.06)
    ring = [(10.0, 10.0), (50.0, 10.0), (50.0, 50.0), (10.0, 50.0)]
    areas = spark.createDataFrame([(1, ring, 0.0), (2, ring, 4.0), (3, ring, None)], f"ord int, pts {shapes.POINTS}, v double")
    style = {"pattern": "lines", "spacing_mm": 2.0, "rotation_deg": 0, "outline": False, "driven": {"spacing": {"field": "v", "least": 1.0, "most": 4.0}}}
    ink = lambda n: feature_paths(spark, {"kind": "polygon", "rows": areas.where(f"ord = {n} or ord = 1 and {n} = 2"), "style": style}, sheet)[0].agg(F.sum(shapes.path_length(F.col("pts")))).first()[0]
    assert ink(2) == pytest.approx(1600 / 1.0 + 1600 / 4.0, rel=0.06) and ink(3) == pytest.approx(1600 / 2.0, rel=0.06)
    with pytest.raises(KeyError, match="colour"):
        feature_paths(spark, {"kind": "point", "rows": rows, "style": {"driven": {"colour": {"field": "girth"}}}}, sheet)


def test_region_windows_and_pieces(spark):
    """Pieces lie on their own sheet with a guide on the surface, windows are cut in the surface; figures stand on either."""
    from maploom.plans.compile import Inputs, compile_drawing

    frame = Frame(20, 20, 1.0, 0.0, 20.0)
    cells = synthetic(spark, 20, 20, lambda c, r: F.when((F.abs(c - 10) < 4) & (F.abs(r - 10) < 4), 12.0).otherwise(0.0))
    spec = lambda **r: {"contours": {"enabled": False}, "regions": {"enabled": True, "threshold": 6.0, **r}}
    sheets = lambda p: {(r.layer, r.sheet) for r in p.where("kind = 'regions'").select("layer", "sheet").distinct().collect()}
    p, c, _ = compile_drawing(spark, Inputs(cells, frame), spec(sheet="felt"))
    assert sheets(p) == {("DLF-04_cut_inner", "felt"), ("DLF-01_score_light", None), ("DLF-01_score_light", "felt")} and c.count() == 4
    p, c, _ = compile_drawing(spark, Inputs(cells, frame), spec(mode="window", labels=False))
    assert sheets(p) == {("DLF-04_cut_inner", None)} and c.count() == 0
    with pytest.raises(ValueError, match="window"):
        compile_drawing(spark, Inputs(cells, frame), spec(mode="hole"))


def test_findings_of_a_clipped_drawing(spark):
    """What the boundary drops and cuts, marks that are too small, breaks in sections, unmeasured features, and a report's lines."""
    from maploom.plans.compile import Inputs, compile_drawing
    from maploom.plans.findings import cutting_report, findings

    frame = Frame(40, 40, 1.0, 0.0, 40.0)
    cells = synthetic(spark, 40, 40, lambda c, r: F.when((c > 10) & (c < 15), None).otherwise(F.hypot(c - 20, r - 20)))
    image = spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"), F.lit(10).alias("red"), F.lit(20).alias("green"), F.lit(30).alias("blue"))
    trees = spark.createDataFrame([(1, 5.0, 5.0, 1.0), (2, 30.0, 5.0, None), (3, 99.0, 5.0, 2.0)], "ord int, x double, y double, girth double")
    layer = {"kind": "point", "name": "trees", "rows": trees, "style": {"driven": {"size": {"field": "girth", "least": 1.0, "most": 3.0}}}}
    inputs = Inputs(cells, frame, pixels=image, image_size=(20, 20), layers=[layer])
    spec = {"sheet": {"scale": 200, "frame": False}, "contours": {"enabled": False}, "sections": {"enabled": True, "count": 3}, "symbols": {"enabled": True, "across": 10},
            "halftone": {"enabled": True, "across": 10, "min_radius_mm": 50.0}, "clip": {"rings": [[(0, 0), (100, 0), (100, 200), (0, 200)]]}}
    got = {(r.stage, r.what): r for r in findings(spark, inputs, spec).collect()}
    n = {k: r.n for k, r in got.items()}
    assert n["raster", "cells"] == 1600 and n["raster", "measured"] == 1600 - 4 * 40
    assert n["halftone", "marks"] == 0 and n["halftone", "too small"] == 100 and got["halftone", "budget"].note == "comfortable"
    assert n["sections", "cuts"] == 3 and n["sections", "breaks"] == 3
    assert (n["features trees", "drawn"], n["features trees", "off the sheet"], n["features trees", "unmeasured"]) == (2, 1, 1)
    lines, rounds, _ = compile_drawing(spark, inputs, spec)
    whole, every, _ = compile_drawing(spark, inputs, {**spec, "clip": {"rings": None}})
    assert n["clip", "circles dropped"] == every.count() - rounds.count() > 0 and n["clip", "paths dropped"] + lines.count() >= whole.count()
    assert n["clip", "paths dropped"] > 0 and n["clip", "paths cut"] > 0
    missed = findings(spark, inputs, {**spec, "clip": {"rings": [[(900, 900), (950, 900), (950, 950)]]}}).where("stage = 'clip'").first()
    assert missed.n == 0 and "misses" in missed.note
    text = [r.line for r in cutting_report(spark, inputs, spec, lines, rounds).orderBy("part", "ord").collect()]
    assert any(line.startswith("sections, breaks: 3") for line in text) and any(line.startswith("whole drawing") for line in text)


def test_hachures_run_down_a_cone(spark):
    """Ticks begin on their contour, point away from the top, and are as long as the slopes met ask for."""
    lines = contours.trace(cone(spark), CONE, 4.0, 10.0, 38.0).cache()
    ticks = paths.hachures(lines, cone(spark), CONE, ["level", "path", "piece"])
    got = ticks.collect()
    top = lines.where("level = 38 or level = 36").select(F.explode("pts").alias("p")).agg(F.avg("p.x"), F.avg("p.y")).first()
    away = lambda x, y: math.hypot(x - top[0], y - top[1])
    assert got and all(away(t.bx, t.by) > away(t.ax, t.ay) for t in got)
    long_ = [math.hypot(t.bx - t.ax, t.by - t.ay) for t in got]
    assert max(long_) <= 2 * CONE.cell + 1e-9 and min(long_) >= 0.7 * CONE.cell - 1e-9


def test_numbers_in_order(spark):
    """Numbers run on through the ranges that the rows are dealt by; an empty table has none."""
    from maploom.operators.graph import numbered

    keys = random.Random(3).sample(range(10000), 500)
    rows = spark.createDataFrame([(k, str(k)) for k in keys], "k int, s string")
    assert [(r.n, r.k) for r in numbered(rows, "n", "k").orderBy("k").collect()] == list(enumerate(sorted(keys), 1))
    assert numbered(rows.where("k < 0"), "n", "k").count() == 0


def test_solid_rows_fill_a_triangle(spark):
    """Rows stay half a burn inside, no further apart than asked; a sliver gets dots or nothing."""
    ring = lambda *xy: [(float(x), float(y)) for x, y in xy]
    rows = spark.createDataFrame([(1, ring((0, 0), (6, 0), (3, 6))), (2, ring((0, 0), (0.2, 0), (0.2, 5), (0, 5))), (3, ring((0, 0), (0.01, 0), (0.01, 5), (0, 5))), (4, None)], f"ord int, pts {shapes.POINTS}")
    got = {}
    for r in fills.solid_rows(rows, ["ord"]).orderBy("ord", "row").collect():
        got.setdefault(r.ord, []).append(r.pts)
    assert set(got) == {1, 2}
    ys = [p[0].y for p in got[1]]
    assert min(ys) == pytest.approx(fills.BURN_MM / 2) and max(b - a for a, b in zip(ys, ys[1:])) <= fills.SOLID_MM + 1e-9
    assert all(p[0].x >= p[0].y / 2 - 1e-9 and p[1].x <= 6 - p[0].y / 2 + 1e-9 for p in got[1])
    assert all(p[1].x - p[0].x == pytest.approx(1e-6) for p in got[2])


def test_plain_images_cover_the_raster(spark):
    """Halftone marks of an image without a frame reach over the whole sheet, whatever its resolution."""
    image = spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"), F.lit(10).alias("red"), F.lit(20).alias("green"), F.lit(30).alias("blue"))
    frame = Frame(60, 60, 1.0, 0.0, 60.0)
    inputs = Inputs(synthetic(spark, 60, 60, lambda c, r: c), frame, pixels=image, image_size=(20, 20))
    _, c, sheet = compile_drawing(spark, inputs, {"contours": {"enabled": False}, "halftone": {"enabled": True, "across": 20, "licence": "own"}})
    x0, x1, y0, y1 = c.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    half = sheet.width / 40
    assert (x0, x1, y0, y1) == pytest.approx((half, sheet.width - half, half, sheet.height - half))


def test_weight_of_lettering_and_solid_furniture(spark):
    """Small lettering is the beam's own line; from 5 mm on strokes are bands, filled. A scale bar's ink ends where it ends."""
    from maploom.plans.compile import furniture

    text = spark.createDataFrame([(1, "L", 0.0, 0.0, 0.0)], "n int, text string, x double, y double, angle double")
    small, large = (lettering.lettered(text, ["n"], size).collect() for size in (3.2, 10.0))
    assert lettering.letter_weight(4.9) == 0 and lettering.letter_weight(5.0) == pytest.approx(0.3)
    assert not any(r.closed for r in small) and any(r.closed for r in large) and any(not r.closed for r in large)
    sheet = Sheet(Frame(100, 100, 1.0, 0.0, 100.0), 500)
    bar = furniture(spark, merged({"furniture": {"enabled": True, "north": False}}), sheet)[0].collect()
    xs = [p.x for r in bar for p in r.pts]
    assert max(xs) - min(xs) == pytest.approx(40 - fills.BURN_MM) and not any(r.closed for r in bar)


def test_hatching_of_a_long_raster(spark):
    """A turned line is walked near the extent only, its steps are not broadcast, and the marks are those of a walk along whole lines."""
    nrows, ncols, spacing, step, turn = 300, 6, 3.0, 2.0, math.radians(45)
    z = lambda c, r: F.when((c + r) % 11 == 3, None).otherwise((c * 7 + r * 3) % 20 / 18)
    frame = Frame(nrows, ncols)
    got = symbols.hatch_field(synthetic(spark, nrows, ncols, z), frame, 0, 1, spacing, step, 45, 0.2)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    ux, uy = math.cos(turn), math.sin(turn)
    corners = [(x, y) for x in (0, ncols) for y in (0, nrows)]
    s_all, t_all = [y * ux - x * uy for x, y in corners], [x * ux + y * uy for x, y in corners]
    want = []

    def emit(s, a, b):
        # Where the line is inside both ways.
        lo = max(a, s * uy / ux, -s * ux / uy)
        hi = min(b, (ncols + s * uy) / ux, (nrows - s * ux) / uy)
        if b - a >= 0.2 and hi - lo >= 0.2:
            want.append((round(s * ux + lo * uy, 4), round(hi - lo, 4)))

    for k in range(math.ceil(min(s_all) / spacing) - 1, math.floor(max(s_all) / spacing) + 2):
        s, start = k * spacing, None
        t = math.floor(min(t_all) / step) * step - step
        while t < max(t_all) + step:
            x, y = (t + step / 2) * ux - s * uy, (t + step / 2) * uy + s * ux
            c, r = min(max(math.floor(x), 0), ncols - 1), min(max(math.floor(nrows - y), 0), nrows - 1)
            d = None if (c + r) % 11 == 3 else min((c * 7 + r * 3) % 20 / 18, 1)
            if d is not None and d >= 0.98:
                start = t if start is None else start
            else:
                if start is not None:
                    emit(s, start, t)
                start = None
                if d:
                    emit(s, t + step / 2 - d * step / 2, t + step / 2 + d * step / 2)
            t += step
        if start is not None:
            emit(s, start, t)
    have = [(round(r.ay, 4), round(math.hypot(r.bx - r.ax, r.by - r.ay), 4)) for r in got.collect()]
    assert len(want) > 200 and np.array(sorted(have)) == pytest.approx(np.array(sorted(want)), abs=2e-4)
