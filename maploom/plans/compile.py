"""From a specification to one drawing: the stages in the machine's order, clipped last."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maploom.functions import shapes
from maploom.functions.colour import SHEET_PASS, refuse_restricted
from maploom.functions.frames import Frame, Sheet, stretched
from maploom.functions.scales import angle_value, nice_interval, scale_value
from maploom.operators import contours, drawing, features, fills, focal, flow, kernels, lettering, paths, regions, sampling, symbols
from maploom.plans.storage import stored

#: What each stage is drawn with, unless the specification says otherwise.
DEFAULTS: dict[str, dict] = {
    "sheet": {"scale": 200, "margin": 0.0, "frame": True, "title": ""},
    "contours": {"enabled": True, "interval": 0.0, "index_every": 5, "min_length": 1.5, "labels": True, "label_every": 5, "label_size": 2.2, "label_spacing": 55.0, "datum": 0.0, "style": "solid",
                 "layer": "DLF-02_score_medium", "index_layer": "DLF-03_score_strong", "label_layer": "DLF-01_score_light"},
    "hachures": {"enabled": False, "layer": "DLF-01_score_light"},
    "photos": {"enabled": True, "mark": "circle", "size": 3.0, "layer": "DLF-03_score_strong"},
    "regions": {"enabled": False, "threshold": 0.0, "min_area": 0.0, "source": "self", "mode": "overlay", "sheet": "overlay", "guide": True, "labels": True, "label_size": 2.2, "layer": "DLF-04_cut_inner",
                "label_layer": "DLF-01_score_light"},
    "symbols": {"enabled": False, "source": "self", "across": 40, "layer": "DLF-02_score_medium"},
    "hatch": {"enabled": False, "source": "self", "spacing": 4.0, "angle_deg": 45.0, "layer": "DLF-01_score_light"},
    "halftone": {"enabled": False, "across": 90, "channel": "darkness", "min_radius_mm": 0.2, "licence": "own", "layer": "DLF-00_engrave"},
    "sections": {"enabled": False, "count": 3, "axis": "horizontal", "shared": False, "layer": "DLF-02_score_medium"},
    "features": {"enabled": True},
    "furniture": {"enabled": False, "scale_bar": True, "north": True, "title_size": 3.2, "label_size": 1.8, "layer": "DLF-02_score_medium"},
    "clip": {"rings": None},
}


def merged(spec: dict | None) -> dict[str, dict]:
    """The defaults with a specification over them, one level deep; stages that don't exist are refused."""
    spec = spec or {}
    if unknown := set(spec) - set(DEFAULTS):
        raise KeyError(f"no such stage: {', '.join(sorted(unknown))}")
    return {name: {**base, **spec.get(name, {})} for name, base in DEFAULTS.items()}


@dataclass
class Inputs:
    """Cells of the first raster with their frame; the rest is optional. Features are layers of (kind, rings or points, style);
    other is a raster on the same grid, which the source "difference" takes the first one from. An image without a frame is stretched
    over the raster."""

    cells: DataFrame
    frame: Frame
    photos: DataFrame | None = None
    pixels: DataFrame | None = None
    image_size: tuple[int, int] = (0, 0)
    layers: list[dict] = field(default_factory=list)
    other: DataFrame | None = None
    image_frame: Frame | None = None

    def image_at(self) -> Frame:
        return self.image_frame or stretched(self.frame, *self.image_size)


def resolve(source: str, inputs: Inputs) -> DataFrame:
    """r, c, z of a derived surface by name."""
    c, cell = inputs.cells, inputs.frame.cell
    if source == "self":
        return c.select("r", "c", F.col("z").cast("double").alias("z"))
    if source == "difference":
        if inputs.other is None:
            raise ValueError("a difference needs a second raster")
        return focal.difference(c, inputs.other)
    made = {"slope": lambda: focal.slope_degrees(c, cell), "tri": lambda: focal.ruggedness(c), "roughness": lambda: focal.roughness(c),
            "twi": lambda: flow.wetness(c.withColumn("raster", F.lit(0)), cell)}[source]()
    return made.select("r", "c", F.col("v").alias("z"))


#: How each derived surface is to be described.
NOTES = {"slope": "slope in degrees, Horn's method", "tri": "Terrain Ruggedness Index (Riley 1999), elevation units", "roughness": "the 3x3 range, elevation units",
         "twi": "Topographic Wetness Index, ln(a / tan B), multiple flow (Freeman, p = 1.1) over a filled surface"}


def _mm(sheet: Sheet, pts: str = "pts"):
    return F.transform(pts, lambda p: shapes.point(sheet.x(p["x"]), sheet.y(p["y"])))


def _segment(sheet: Sheet):
    return shapes.points((sheet.x(F.col("ax")), sheet.y(F.col("ay"))), (sheet.x(F.col("bx")), sheet.y(F.col("by"))))


def compile_drawing(spark: SparkSession, inputs: Inputs, spec: dict | None = None, export: bool = False) -> tuple[DataFrame, DataFrame, Sheet]:
    """(paths, circles, sheet) in sheet mm: nothing that isn't switched on is planned, and clipping comes last,
    after everything that looks at a whole raster or places a pattern in the world."""
    lines, rounds, sheet = assembled(spark, inputs, spec, export)
    if boundary := clip_rings(merged(spec), sheet):
        lines = paths.clip_drawing(lines, boundary, KEPT, F.col("furniture")).select(*KEPT, "closed", "pts")
        rounds = paths.clip_circles(rounds, boundary)
    return lines, rounds, sheet


KEPT = ["layer", "kind", "sheet", "furniture"]


def clip_rings(s: dict[str, dict], sheet: Sheet) -> list[np.ndarray]:
    """The boundary to clip to; none if it misses the sheet, and everything is kept."""
    boundary = [np.asarray(ring, float) for ring in s["clip"]["rings"] or []]
    every = np.vstack(boundary) if boundary else np.empty((0, 2))
    meets = len(every) and every[:, 0].max() >= 0 and every[:, 1].max() >= 0 and every[:, 0].min() <= sheet.width and every[:, 1].min() <= sheet.height
    return boundary if meets else []


def assembled(spark: SparkSession, inputs: Inputs, spec: dict | None = None, export: bool = False) -> tuple[DataFrame, DataFrame, Sheet]:
    """compile_drawing before clipping."""
    s = merged(spec)
    f = inputs.frame
    sheet = Sheet(f, s["sheet"]["scale"], s["sheet"]["margin"])
    lines: list[DataFrame] = []
    rounds: list[DataFrame] = []
    spots: list[DataFrame] = []
    on_paper = lambda df: df.withColumn("x", sheet.x(F.col("x"))).withColumn("y", sheet.y(F.col("y"))).withColumn("radius", F.col("radius") * sheet.mm_per_unit)

    h = s["halftone"]
    if h["enabled"] and inputs.pixels is not None:
        if export:
            refuse_restricted(h["licence"])
        dots = on_paper(symbols.halftone(inputs.pixels, *inputs.image_size, inputs.image_at(), h["across"], (h["channel"],)))
        rounds.append(drawing.as_circles(dots.where(F.col("radius") >= h["min_radius_mm"]), h["layer"], "halftone"))

    c = s["contours"]
    traced = None
    if c["enabled"]:
        lo, hi, relief = focal.stats(inputs.cells).select(F.col("lo").cast("double"), F.col("hi").cast("double"), F.col("relief").cast("double")).first()
        if lo is not None:
            interval = c["interval"] or spark.range(1).select(nice_interval(F.lit(relief), 14)).first()[0]
            traced = stored(contours.trace(inputs.cells, f, interval, lo, hi, c["index_every"], min_length=c["min_length"] / sheet.mm_per_unit), "contours")
            flat = traced.withColumn("pts", _mm(sheet)).withColumn("level", F.col("level") - c["datum"])
            if c["labels"]:
                placed = stored(lettering.place_labels(flat, interval, ["level", "path", "piece", "closed", "index", "pts"], c["label_every"], c["label_size"], c["label_spacing"]), "labels")
                spots_at = placed.select("level", "text", F.explode("boxes").alias("b")).select("level", "text", F.col("b.cx").alias("x"), F.col("b.cy").alias("y"), F.col("b.angle").alias("angle"))
                spots.append(drawing.as_paths(lettering.text_strokes(spots_at, ["level"], c["label_size"], 6, "middle", "middle"), c["label_layer"], "contour-labels"))
                flat = paths.gapped(placed, "boxes", ["level", "index"])
            layer = F.when(F.col("index"), c["index_layer"]).otherwise(c["layer"])
            if c["style"] != "solid":
                flat = paths.styled(flat, c["style"], ["level", "index"]).withColumn("closed", F.lit(False))
            lines.append(drawing.as_paths(flat, layer, "contours", closed="closed"))
            lines += spots
    g = s["hachures"]
    if g["enabled"] and traced is not None:
        ticks = paths.hachures(traced, inputs.cells, f, ["level", "path", "piece"])
        lines.append(drawing.as_paths(ticks.select(_segment(sheet).alias("pts")), g["layer"], "hachures"))

    p = s["photos"]
    if p["enabled"] and inputs.photos is not None:
        placed = features.place_photos(inputs.photos, inputs.cells, f).where("inside")
        at = placed.select("n", sheet.x(F.col("x")).alias("x"), sheet.y(F.col("y")).alias("y"))
        if p["mark"] == "circle":
            rounds.append(drawing.as_circles(at.withColumn("radius", F.lit(p["size"] / 2)), p["layer"], "photos"))
        else:
            lines.append(drawing.as_paths(features.photo_marks(at, ["n"], p["mark"], p["size"]), p["layer"], "photos"))

    r = s["regions"]
    if r["mode"] not in ("overlay", "window"):
        raise ValueError(f"regions are an overlay or a window, not {r['mode']}")
    if r["enabled"]:
        surface = resolve(r["source"], inputs)
        rings = stored(regions.region_rings(surface, f, r["threshold"], r["min_area"]).select(_mm(sheet).alias("pts")).withColumn("closed", F.lit(True)), "rings")
        piece = r["sheet"] if r["mode"] == "overlay" else None
        lines.append(drawing.as_paths(rings, r["layer"], "regions", piece, "closed"))
        if piece and r["guide"]:
            # The pieces' places, scored on the surface that they are glued to.
            lines.append(drawing.as_paths(rings, r["label_layer"], "regions", None, "closed"))
        if r["labels"]:
            size = F.abs("mean")
            text = F.when(size >= 10, F.format_string("%.0f", size)).otherwise(F.format_string("%.1f", size))
            spot = regions.regions(surface, f, r["threshold"], r["min_area"]).select("region", text.alias("text"), sheet.x(F.col("x")).alias("x"), sheet.y(F.col("y")).alias("y"), F.lit(0.0).alias("angle"))
            lines.append(drawing.as_paths(lettering.text_strokes(spot, ["region"], r["label_size"], 6, "middle", "middle"), r["label_layer"], "regions", piece))

    y = s["symbols"]
    if y["enabled"]:
        stride = max(1, int(max(f.nrows, f.ncols) / max(4, y["across"]) + 0.5))
        dots = on_paper(symbols.symbol_field(resolve(y["source"], inputs), f, stride))
        rounds.append(drawing.as_circles(symbols.on_sheet(dots, sheet.width, sheet.height), y["layer"], "symbols"))

    t = s["hatch"]
    if t["enabled"]:
        surface = stored(resolve(t["source"], inputs), "surface")
        lo, hi = surface.agg(F.min("z"), F.max("z")).first()
        if lo is not None:
            marks = symbols.hatch_field(surface, f, lo, hi, t["spacing"], None, t["angle_deg"], 0.4 / sheet.mm_per_unit)
            lines.append(drawing.as_paths(marks.select(_segment(sheet).alias("pts")), t["layer"], "hatch"))

    if s["features"]["enabled"]:
        for layer in inputs.layers:
            lines += feature_paths(spark, layer, sheet)

    q = s["sections"]
    if q["enabled"]:
        cut = sampling.sections(inputs.cells, f, q["count"], q["axis"], shared=q["shared"]).where("v is not null")
        runs = cut.groupBy("section", "run").agg(F.array_sort(F.collect_list(F.struct("j", sheet.x(F.col("x")).alias("x"), sheet.y(F.col("y")).alias("y")))).alias("s")).where(F.size("s") > 1)
        lines.append(drawing.as_paths(runs.select(F.transform("s", lambda e: shapes.point(e["x"], e["y"])).alias("pts")), q["layer"], "sections"))

    edge_points = shapes.points(*[(F.lit(a), F.lit(b)) for a, b in [(0.0, 0.0), (sheet.width, 0.0), (sheet.width, sheet.height), (0.0, sheet.height)]])
    edge = spark.range(1).select(edge_points.alias("pts"), F.lit(True).alias("closed"))
    if s["sheet"]["frame"]:
        lines.append(drawing.as_paths(edge, SHEET_PASS, "frame", closed="closed", furniture=True))
    below = [r["sheet"]] if r["enabled"] and r["mode"] == "overlay" else []
    if below:
        # Holes for dowels through every sheet; the pair is no mirror image of itself, so that no sheet can lie the wrong way round.
        for name in [None, *below]:
            holes = spark.createDataFrame([(x, y, REGISTRATION[2]) for x, y in ((REGISTRATION[0], REGISTRATION[0]), (sheet.width - REGISTRATION[0], sheet.height - REGISTRATION[1]))], "x double, y double, radius double")
            rounds.append(drawing.as_circles(holes, REGISTRATION_PASS, "registration", name))
        lines += [drawing.as_paths(edge, SHEET_PASS, "frame", name, "closed", True) for name in below]
    lines += furniture(spark, s, sheet)

    # Written stage by stage: the driver plans, compiles and runs one at a time, and not all of a drawing's in one query.
    lines, rounds = [stored(x, "lines") for x in lines], [stored(x, "rounds") for x in rounds]
    empty = lambda schema: spark.createDataFrame([], schema)
    all_lines = reduce(DataFrame.unionByName, lines) if lines else empty(drawing.PATHS)
    all_rounds = reduce(DataFrame.unionByName, rounds) if rounds else empty(drawing.CIRCLES)
    return all_lines, all_rounds, sheet


# The registration holes' distances from two corners, and their radius, in mm.
REGISTRATION, REGISTRATION_PASS = (6.0, 10.0, 1.25), "DLF-04_cut_inner"


def furniture(spark: SparkSession, s: dict[str, dict], sheet: Sheet) -> list[DataFrame]:
    """Title, scale bar and north point, each where it fits: inwards from its corner until all its corners lie inside the clip's
    boundary. A piece that fits nowhere is left out."""
    g, title = s["furniture"], s["sheet"]["title"]
    boundary = [np.asarray(ring, float) for ring in s["clip"]["rings"] or []]
    every = np.vstack(boundary) if boundary else np.array([(0.0, 0.0), (sheet.width, sheet.height)])
    (x0, y0), (x1, y1) = every.min(axis=0).tolist(), every.max(axis=0).tolist()

    def free(x, y, w, h):
        px, py = np.array([x, x + w, x + w, x]) + x0, np.array([y, y, y + h, y + h]) + y0
        return bool(kernels.in_rings(px, py, boundary).all()) if boundary else w <= x1 - x0 and h <= y1 - y0

    inset, strokes, solid, texts = max(s["sheet"]["margin"], 4.0), [], [], []

    def place(w, h, corner):
        at = drawing.seek(x1 - x0 - 2 * inset, y1 - y0 - 2 * inset, w, h, lambda x, y, a, b: free(x + inset, y + inset, a, b), corner)
        return None if at is None else (at[0] + x0 + inset, at[1] + y0 + inset)

    if title:
        w, h = lettering.text_size(str(title), g["title_size"], 6)
        if at := place(w, h, "nw"):
            texts.append((str(title), at[0], at[1], 0.0, float(g["title_size"])))
    if g["enabled"] and g["scale_bar"]:
        bar = drawing.scale_bar(sheet)
        label = g["label_size"]
        if at := place(bar["mm"], 1.8 + 0.6 + label, "sw"):
            left, low = min(x for ring in bar["rings"] for x, _ in ring), min(y for ring in bar["rings"] for _, y in ring)
            # A bar is as long as its number says, so it's filled up to its edges and not outlined.
            solid += [[(x - left + at[0], y - low + at[1]) for x, y in ring] for ring in bar["rings"]]
            texts.append((bar["label"], at[0], at[1] + 2.4, 0.0, float(label)))
    if g["enabled"] and g["north"]:
        if at := place(10.0, 14.0, "se"):
            n = drawing.north_point(at[0] + 5, at[1] + 5)
            strokes += [n["ring"], n["needle"], n["pivot"]]
            solid += [n["needle"], n["pivot"]]
            texts.append(("N", at[0] + 5 - lettering.text_size("N", 3.0, 6)[0] / 2, n["label_y"], 0.0, 3.0))
    out = []
    rows = lambda rings: spark.createDataFrame([(i, [(float(x), float(y)) for x, y in ring]) for i, ring in enumerate(rings)], "n int, pts " + shapes.POINTS)
    if strokes:
        out.append(drawing.as_paths(rows(strokes), g["layer"], "furniture", closed=True, furniture=True))
    if solid:
        out.append(drawing.as_paths(fills.solid_rows(rows(solid), ["n"]), g["layer"], "furniture", furniture=True))
    for size in sorted({t[4] for t in texts}):
        said = spark.createDataFrame([(i, *t[:4]) for i, t in enumerate(texts) if t[4] == size], "n int, text string, x double, y double, angle double")
        out.append(drawing.as_paths(lettering.lettered(said, ["n"], size), g["layer"], "furniture", closed="closed", furniture=True))
    return out


def areas(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, ord, owner, rings: each outline with the holes that lie in it, of rows (keep..., ord, pts[, ring, hole]).

    Without a column hole every row is an outline of its own. Outlines are filled one by one, so those that overlap both show.
    """
    named = rows if "ring" in rows.columns else rows.withColumn("ring", F.row_number().over(Window.partitionBy("ord").orderBy(F.xxhash64("pts"))))
    if "hole" not in rows.columns:
        return named.select(*keep, "ord", F.col("ring").alias("owner"), F.array("pts").alias("rings"))
    held = features.group_rings(named.select("ord", "ring", "hole", "pts"), ["ord"])
    first = named.where("not hole").groupBy("ord").agg(*[F.first(k).alias(k) for k in keep]) if keep else None
    out = held.groupBy("ord", "owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring", "pts"))), lambda x: x["pts"]).alias("rings"))
    return out if first is None else out.join(first, "ord", "left")


def attributed(layer: dict, style: dict) -> DataFrame:
    """A layer's rows with a column for each target that style["driven"] names: size, width or spacing in mm, rotation in degrees.

    driven holds target: {field, lo, hi, least, most, mode, offset}; lo and hi are the field's extremes if they aren't given.
    Values come from the rows, or from layer["attributes"] (ord, field...). Spacing is tightest for the highest value. Where a
    value is missing the column is null, and the style's fixed measure stands.
    """
    rows, driven = layer["rows"], style.get("driven", {})
    if unknown := set(driven) - {"size", "width", "spacing", "rotation"}:
        raise KeyError(f"nothing to drive by a field: {', '.join(sorted(unknown))}")
    if driven and layer.get("attributes") is not None:
        rows = features.bind(rows, layer["attributes"], sorted({by["field"] for by in driven.values()}))
    for target, by in driven.items():
        value = F.col(by["field"]).cast("double")
        value = F.when(~F.isnan(value), value)
        if "lo" not in by or "hi" not in by:
            # One row.
            rows = rows.join(F.broadcast(rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))))
        lo, hi = (F.lit(float(by[k])) if k in by else F.col(f"_{k}") for k in ("lo", "hi"))
        if target == "rotation":
            made = F.degrees(angle_value(value, lo, hi, by.get("mode", "degrees"), by.get("offset", 0)))
        else:
            ends = (float(by["most"]), float(by["least"])) if target == "spacing" else (float(by["least"]), float(by["most"]))
            made = scale_value(value, lo, hi, *ends, by.get("mode", "area" if target == "size" else "linear"))
        rows = rows.withColumn(target, F.when(value.isNotNull(), made)).drop("_lo", "_hi")
    return rows


def _point_paths(rows: DataFrame, style: dict, sheet: Sheet) -> list[DataFrame]:
    at = rows.withColumn("x", sheet.x(F.col("x"))).withColumn("y", sheet.y(F.col("y")))
    radius = F.coalesce(F.col("size").cast("double"), F.lit(float(style["radius_mm"]))) if "size" in rows.columns else style["radius_mm"]
    turn = F.radians(F.coalesce(F.col("rotation").cast("double"), F.lit(0.0))) if "rotation" in rows.columns else 0.0
    drawn = features.point_symbols(at, ["ord"], style["symbol"], radius, turn, sheet.width, sheet.height)
    rings = drawn.withColumn("closed", F.col("pts")[0] == F.element_at("pts", -1))
    rings = rings.withColumn("pts", F.when(F.col("closed"), F.slice("pts", 1, F.size("pts") - 1)).otherwise(F.col("pts")))
    pattern = features.LINE_TYPES[style["line_type"]]
    out = [drawing.as_paths(paths.dashed(rings, pattern, ["ord", "part"]) if pattern else drawn, style["layer"], "features")]
    if style["pattern"] != "none":
        areas_ = rings.where("closed").select("ord", "part", F.array("pts").alias("rings"))
        made = fills.fill_features(areas_, ["ord", "part"], style["pattern"], style["spacing_mm"], 0.0, 0.3, style.get("most_rows"), style.get("most_symbols"))
        out.append(drawing.as_paths(made, style["layer"], "features"))
    return out


def feature_paths(spark: SparkSession, layer: dict, sheet: Sheet) -> list[DataFrame]:
    """A feature layer's strokes: points (ord, x, y) as symbols, outlined and filled like areas; lines and areas (ord, pts[, ring,
    hole]) outlined or as bands, and each area filled by itself, its holes left out. size, width, spacing and rotation are the
    rows' own where they have such columns, or are driven by a field (attributed)."""
    kind = layer["kind"]
    style = {**features.DEFAULTS[kind], **layer.get("style", {})}
    rows = attributed(layer, style)
    if kind == "point":
        return _point_paths(rows, style, sheet)
    flat = rows.withColumn("pts", _mm(sheet)).withColumn("closed", F.lit(kind == "polygon"))
    flat = flat.where(F.exists("pts", lambda p: sheet.holds(p["x"], p["y"])))
    out = []
    if kind == "line" or style["outline"]:
        if style.get("width_mm"):
            width = float(style["width_mm"])
            if "width" in rows.columns:
                flat, width = flat.withColumn("width", F.coalesce(F.col("width").cast("double"), F.lit(width))), "width"
            out.append(drawing.as_paths(paths.bands(flat, width, ["ord"]).withColumn("closed", F.lit(True)), style["layer"], "features", closed="closed"))
        elif features.LINE_TYPES[style["line_type"]]:
            out.append(drawing.as_paths(paths.dashed(flat, features.LINE_TYPES[style["line_type"]], ["ord"]), style["layer"], "features"))
        else:
            out.append(drawing.as_paths(flat, style["layer"], "features", closed="closed"))
    if kind == "polygon" and style["pattern"] != "none":
        sized = [k for k in ("spacing", "rotation") if k in rows.columns]
        regions_ = areas(flat, sized)
        if style["pattern"] == "echo":
            # An echo's distance field is made for one region at a time, held by the driver: a layer's outlines, as its author drew them.
            for row in regions_.select("rings").toLocalIterator():
                rings = [np.array([(p["x"], p["y"]) for p in r]) for r in row[0]]
                out.append(drawing.as_paths(fills.echo(spark, rings, style["spacing_mm"], 0.3), style["layer"], "features"))
        else:
            spacing = F.coalesce("spacing", F.lit(float(style["spacing_mm"]))) if "spacing" in sized else style["spacing_mm"]
            turned = F.coalesce("rotation", F.lit(float(style["rotation_deg"]))) if "rotation" in sized else style["rotation_deg"]
            made = fills.fill_features(regions_, ["ord", "owner"], style["pattern"], spacing, turned, 0.3, style.get("most_rows"), style.get("most_symbols"))
            out.append(drawing.as_paths(made, style["layer"], "features"))
    return out
