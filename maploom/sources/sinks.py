"""Drawings as DXF, SVG, shapefiles, engraving rasters and reports."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.functions import shapes
from maploom.functions.colour import COLOURS, ENGRAVE, PASSES, SHEET_PASS
from maploom.functions.frames import Sheet
from maploom.functions.text import plain_number, xml_escaped
from maploom.operators.drawing import of_sheet, totals
from maploom.operators.fills import BURN_MM
from maploom.sources import vector

EOL = "\r\n"


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


# ---------------------------------------------------------------- DXF


def _group(*pairs: tuple[int, Column | str]) -> Column:
    return F.concat_ws(EOL, *[x for code, v in pairs for x in (F.lit(str(code)), v if isinstance(v, Column) else F.lit(v))])


def dxf_entities(paths: DataFrame, circles: DataFrame) -> DataFrame:
    """part, layer, text: one row an entity; polylines of under two points go, and so do points and circles that aren't finite."""
    n = plain_number
    vertex = lambda p: _group((0, "VERTEX"), (8, F.col("layer")), (10, n(p["x"])), (20, n(p["y"])), (30, "0"))
    good = F.filter("pts", lambda p: _finite(p["x"]) & _finite(p["y"]))
    head = _group((0, "POLYLINE"), (8, F.col("layer")), (66, "1"), (70, F.when(F.col("closed"), "1").otherwise("0")), (10, "0"), (20, "0"), (30, "0"))
    body = F.array_join(F.transform(good, vertex), EOL)
    lines = paths.where(F.size("pts") > 1).select(F.lit(1).alias("part"), "layer", F.concat_ws(EOL, head, F.nullif(body, F.lit("")), _group((0, "SEQEND"), (8, F.col("layer")))).alias("text"))
    ok = circles.where((F.col("radius") > 0) & _finite(F.col("x")) & _finite(F.col("y")))
    rounds = ok.select(F.lit(2).alias("part"), "layer", _group((0, "CIRCLE"), (8, F.col("layer")), (10, n(F.col("x"))), (20, n(F.col("y"))), (30, "0"), (40, n(F.col("radius")))).alias("text"))
    return lines.unionByName(rounds)


def extents(paths: DataFrame, circles: DataFrame) -> DataFrame:
    """x0, y0, x1, y1 of a drawing, zeros if it is empty."""
    b = paths.where(F.size("pts") > 1).select(shapes.bbox(F.filter("pts", lambda p: _finite(p["x"]) & _finite(p["y"]))).alias("b")).select("b.*")
    c = circles.where("radius > 0").select((F.col("x") - F.col("radius")).alias("x0"), (F.col("y") - F.col("radius")).alias("y0"), (F.col("x") + F.col("radius")).alias("x1"), (F.col("y") + F.col("radius")).alias("y1"))
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    return b.unionByName(c).agg(zero(F.min("x0")).alias("x0"), zero(F.min("y0")).alias("y0"), zero(F.max("x1")).alias("x1"), zero(F.max("y1")).alias("y1"))


def to_dxf(paths: DataFrame, circles: DataFrame, sheet: str | None = None) -> DataFrame:
    """part, layer, text of a whole DXF R12 file: header, tables, entities, end; written in the order of part."""
    paths, circles = of_sheet(paths, sheet), of_sheet(circles, sheet)
    n = plain_number
    table = EOL.join(x for name, aci, *_ in PASSES for x in ("0", "LAYER", "2", name, "70", "0", "62", str(aci), "6", "CONTINUOUS"))
    fixed = EOL.join(["0", "ENDSEC", "0", "SECTION", "2", "TABLES", "0", "TABLE", "2", "LTYPE", "70", "1", "0", "LTYPE", "2", "CONTINUOUS", "70", "0", "3", "Solid line", "72", "65", "73", "0", "40", "0", "0", "ENDTAB",
                      "0", "TABLE", "2", "LAYER", "70", str(len(PASSES)), table, "0", "ENDTAB", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"])
    top = _group((0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, "AC1009"), (9, "$INSUNITS"), (70, "4"), (9, "$MEASUREMENT"), (70, "1"),
                 (9, "$EXTMIN"), (10, n(F.col("x0"))), (20, n(F.col("y0"))), (30, "0"), (9, "$EXTMAX"), (10, n(F.col("x1"))), (20, n(F.col("y1"))), (30, "0"))
    head = extents(paths, circles).select(F.lit(0).alias("part"), F.lit(None).cast("string").alias("layer"), F.concat_ws(EOL, top, F.lit(fixed)).alias("text"))
    foot = paths.sparkSession.range(1).select(F.lit(9).alias("part"), F.lit(None).cast("string").alias("layer"), F.lit(EOL.join(["0", "ENDSEC", "0", "EOF"])).alias("text"))
    return head.unionByName(dxf_entities(paths, circles)).unionByName(foot)


def write_ordered(rows: DataFrame, folder: str, order: list[str], column: str = "text", eol: str = EOL) -> None:
    """Text files that, one after the other by name, are the whole in order; no task holds more than its range."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.option("lineSep", eol).text(folder)


# ---------------------------------------------------------------- SVG


def to_svg(paths: DataFrame, circles: DataFrame, width: float, height: float, title: str | None = None, stroke_mm: float = 0.1, sheet: str | None = None, boundary: bool = True) -> DataFrame:
    """part, sub, layer, text: the lines of an SVG, passes in machine order, y turned once."""
    spark = paths.sparkSession
    paths, circles = of_sheet(paths, sheet), of_sheet(circles, sheet)
    n = lambda v: plain_number(v, 4)
    at = lambda p: F.concat_ws(" ", n(p["x"]), n(height - p["y"]))
    d = F.concat(F.lit("M "), F.array_join(F.transform("pts", at), " L "), F.when(F.col("closed"), " Z").otherwise(""))
    order = {p[0]: i + 1 for i, p in enumerate(PASSES)}
    rank = F.lit(None).cast("int")
    for name, i in order.items():
        rank = F.when(F.col("layer") == name, i).otherwise(rank)
    strokes = paths.where(F.size("pts") > 1).select(rank.alias("part"), F.lit(1).alias("sub"), "layer", F.concat(F.lit('    <path d="'), d, F.lit('"/>')).alias("text"))
    dots = circles.select(rank.alias("part"), F.lit(3).alias("sub"), "layer", F.concat(F.lit('      <circle cx="'), n(F.col("x")), F.lit('" cy="'), n(height - F.col("y")), F.lit('" r="'), n(F.col("radius")), F.lit('"/>')).alias("text"))
    body = strokes.unionByName(dots).where("part is not null")
    body = body if boundary else body.where(F.col("layer") != SHEET_PASS)
    plain = lambda v, k=4: f"{v:.{k}f}".rstrip("0").rstrip(".") or "0"
    frames = []
    for name, i in order.items():
        w = max(stroke_mm, BURN_MM) if name == ENGRAVE else stroke_mm
        dash = ' stroke-dasharray="2 2" opacity="0.5"' if name == SHEET_PASS else ""
        frames += [(i, 0, name, f'  <g id="{name}" fill="none" stroke="{COLOURS[name]}" stroke-width="{plain(w)}" stroke-linecap="round" stroke-linejoin="round"{dash}>', None), (i, 5, name, "  </g>", None)]
        fill = f' fill="{COLOURS[name]}" stroke="none"' if name == ENGRAVE else ""
        frames += [(i, 2, name, f"    <g{fill}>", "circle"), (i, 4, name, "    </g>", "circle")]
    schema = "part int, sub int, layer string, text string, only string"
    marks = spark.createDataFrame(frames, schema)
    # Which of the seven passes have anything, and circles: one row each.
    have = body.groupBy("layer").agg(F.max(F.col("sub") == 3).alias("dots"))
    marks = marks.join(F.broadcast(have), "layer").where("only is null or dots").select("part", "sub", "layer", "text")
    top = ['<?xml version="1.0" encoding="UTF-8"?>', f'<svg xmlns="http://www.w3.org/2000/svg" version="1.1" width="{plain(width)}mm" height="{plain(height)}mm" viewBox="0 0 {plain(width)} {plain(height)}">']
    ends = [(0, i, None, t) for i, t in enumerate(top)] + [(99, 0, None, "</svg>")]
    whole = spark.createDataFrame(ends, "part int, sub int, layer string, text string").unionByName(marks).unionByName(body)
    if title:
        named = spark.range(1).select(F.lit(0).alias("part"), F.lit(5).alias("sub"), F.lit(None).cast("string").alias("layer"), F.concat(F.lit("  <title>"), xml_escaped(F.lit(title)), F.lit("</title>")).alias("text"))
        whole = whole.unionByName(named)
    return whole


# ---------------------------------------------------------------- shapefiles


def line_attributes(paths: DataFrame, sheet: Sheet) -> DataFrame:
    """pass, kind, sheet, closed, len_m, n_pts, pts: paths back on the ground, rings with their first point again."""
    shut = F.when(F.col("closed"), F.concat("pts", F.slice("pts", 1, 1))).otherwise(F.col("pts"))
    rows = paths.withColumn("pts", F.transform(shut, lambda p: shapes.point(sheet.inv_x(p["x"]), sheet.inv_y(p["y"])))).where(F.size("pts") > 1)
    kind = F.coalesce("kind", F.when(F.col("furniture"), "furniture").otherwise(""))
    return rows.select(F.coalesce("layer", F.lit("")).alias("pass"), kind.alias("kind"), F.coalesce("sheet", F.lit("surface")).alias("sheet"), "closed", shapes.path_length(F.col("pts")).alias("len_m"), F.size("pts").alias("n_pts"), "pts")


def point_attributes(circles: DataFrame, sheet: Sheet) -> DataFrame:
    """pass, kind, sheet, r_mm, r_m, diam_m, x, y: circles as points on the ground."""
    r = sheet.inv_length(F.col("radius"))
    return circles.select(F.coalesce("layer", F.lit("")).alias("pass"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("sheet", F.lit("surface")).alias("sheet"), F.col("radius").alias("r_mm"), r.alias("r_m"), (r * 2).alias("diam_m"), sheet.inv_x(F.col("x")).alias("x"), sheet.inv_y(F.col("y")).alias("y"))


_LINES = [("pass", "C", 20, 0), ("kind", "C", 16, 0), ("sheet", "C", 12, 0), ("closed", "L", 1, 0), ("len_m", "N", 14, 3), ("n_pts", "N", 8, 0)]
_POINTS = [("pass", "C", 20, 0), ("kind", "C", 16, 0), ("sheet", "C", 12, 0), ("r_mm", "N", 12, 4), ("r_m", "N", 14, 4), ("diam_m", "N", 14, 4)]


def wkt_of(crs: Column) -> Column:
    """A projection file's text for the UTM codes and for 4326, else null."""
    code = F.nullif(F.regexp_extract(F.trim(crs), "(?i)^EPSG:([0-9]+)$", 1), F.lit("")).try_cast("int")
    etrs, north, south = code.between(25828, 25838), code.between(32601, 32660), code.between(32701, 32760)
    zone = F.when(etrs, code - 25800).when(north, code - 32600).when(south, code - 32700)
    datum = F.when(etrs, "ETRS89").otherwise("WGS 84")
    ball = F.when(etrs, 'SPHEROID["GRS 1980",6378137,298.257222101]').otherwise('SPHEROID["WGS 84",6378137,298.257223563]')
    name = F.concat(datum, F.lit(" / UTM zone "), zone, F.when(south, "S").otherwise("N"))
    utm = F.concat(F.lit('PROJCS["'), name, F.lit('",GEOGCS["'), datum, F.lit('",DATUM["'), datum, F.lit('",'), ball, F.lit('],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",'),
                   zone * 6 - 183, F.lit('],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",'), F.when(south, 10000000).otherwise(0), F.lit('],UNIT["metre",1],AXIS["Easting",EAST],AXIS["Northing",NORTH],AUTHORITY["EPSG","'), code, F.lit('"]]'))
    plain = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AXIS["Latitude",NORTH],AXIS["Longitude",EAST],AUTHORITY["EPSG","4326"]]'
    return F.when(zone.isNotNull(), utm).when(code == 4326, plain)


def to_shapefiles(paths: DataFrame, circles: DataFrame, sheet: Sheet, stem: str = "drawing", crs: str | None = None) -> list[tuple[str, bytes]]:
    """(name, bytes) of a layer set. One drawing is one download, so its rows come to the driver here and only here."""
    stem = re.sub(r"[^\w-]+", "-", stem)
    lines, dots = line_attributes(paths, sheet).collect(), point_attributes(circles, sheet).collect()
    wkt = paths.sparkSession.range(1).select(wkt_of(F.lit(crs))).first()[0]
    files = []
    for suffix, rows, kind, fields, geometry in (("lines", lines, 3, _LINES, lambda r: [(p["x"], p["y"]) for p in r["pts"]]), ("points", dots, 1, _POINTS, lambda r: [(r["x"], r["y"])])):
        if rows:
            shp, shx = vector.write_shapes([geometry(r) for r in rows], kind)
            files += [(f"{stem}-{suffix}.shp", shp), (f"{stem}-{suffix}.shx", shx), (f"{stem}-{suffix}.dbf", vector.write_table(fields, [r.asDict() for r in rows]))]
            files += [(f"{stem}-{suffix}.prj", wkt.encode())] if wkt else []
    return files


# ---------------------------------------------------------------- engraving

DPI, MOST_SIDE, MOST_MEGAPIXELS = (72, 150, 300), 16384, 256


def raster_plan(plans: DataFrame) -> DataFrame:
    """width_px, height_px, stroke_mm, widened, megapixels, ok, best_dpi of plans (width, height, dpi, stroke_mm)."""
    scale = F.col("dpi") / 25.4
    px = lambda v: F.greatest(F.floor(F.col(v) * scale + 0.5), F.lit(1)).cast("long")
    floor = 1.5 / scale
    rows = plans.withColumn("width_px", px("width")).withColumn("height_px", px("height"))
    mega = F.col("width_px") * F.col("height_px") / 1e6
    best = F.floor(MOST_SIDE / (F.greatest("width", "height") / 25.4))
    ok = (F.col("width_px") <= MOST_SIDE) & (F.col("height_px") <= MOST_SIDE) & (mega <= MOST_MEGAPIXELS)
    return rows.select("width", "height", "dpi", "width_px", "height_px", F.greatest("stroke_mm", floor).alias("stroke_mm_drawn"), (floor > F.col("stroke_mm") + 1e-9).alias("widened"), mega.alias("megapixels"), ok.alias("ok"), best.cast("long").alias("best_dpi"))


def engraved(paths: DataFrame, circles: DataFrame, height: float, scale: float, stroke_mm: float, tile: int = 256) -> DataFrame:
    """y, x, grey of the pixels that ink touches; scale is pixels per mm. Where passes overlap the darkest wins.

    Each stroke goes to the tiles that its box meets, and each tile is painted by itself, so no task holds the whole picture.
    """
    import pandas as pd

    grey = {p[0]: p[5] for p in PASSES}
    wide = F.when(F.col("layer") == ENGRAVE, F.lit(max(stroke_mm, BURN_MM))).otherwise(F.lit(stroke_mm))
    seg = paths.where(F.col("layer") != SHEET_PASS).select("layer", wide.alias("w"), F.explode(shapes.edges(F.col("pts"), F.col("closed"))).alias("e"))
    px = lambda v: v * scale
    py = lambda v: (height - v) * scale
    seg = seg.select("layer", (F.col("w") * scale / 2).alias("h"), px(F.col("e.a.x")).alias("ax"), py(F.col("e.a.y")).alias("ay"), px(F.col("e.b.x")).alias("bx"), py(F.col("e.b.y")).alias("by"), F.lit(0.0).alias("q"))
    dots = circles.where(F.col("layer") != SHEET_PASS).select("layer", F.when(F.col("layer") == ENGRAVE, F.col("radius") * scale).otherwise(F.lit(stroke_mm * scale / 2)).alias("h"), px(F.col("x")).alias("ax"), py(F.col("y")).alias("ay"), px(F.col("x")).alias("bx"), py(F.col("y")).alias("by"), F.when(F.col("layer") == ENGRAVE, 0.0).otherwise(F.col("radius") * scale).alias("q"))
    ink = seg.unionByName(dots)
    reach = F.col("h") + F.col("q")
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - reach) / tile), F.floor((F.greatest(a, b) + reach) / tile))
    ink = ink.select("*", F.explode(span("ax", "bx")).alias("tx")).select("*", F.explode(span("ay", "by")).alias("ty")).where("tx >= 0 and ty >= 0")

    def paint(key, rows: pd.DataFrame) -> pd.DataFrame:
        tx, ty = key
        x, y = np.meshgrid(np.arange(tile) + tx * tile + 0.5, np.arange(tile) + ty * tile + 0.5)
        out = np.zeros((tile, tile))
        for s in rows.itertuples():
            dx, dy = s.bx - s.ax, s.by - s.ay
            long_ = dx * dx + dy * dy
            t = np.clip(((x - s.ax) * dx + (y - s.ay) * dy) / long_, 0, 1) if long_ else 0.0
            d = np.hypot(x - s.ax - t * dx, y - s.ay - t * dy)
            hit = np.abs(d - s.q) <= s.h if s.q else d <= s.h
            out[hit] = np.maximum(out[hit], grey.get(s.layer, 0.5))
        r, c = np.nonzero(out)
        return pd.DataFrame({"y": r + ty * tile, "x": c + tx * tile, "grey": np.floor(255 * (1 - out[r, c]) + 0.5).astype(int)})

    return ink.groupBy("tx", "ty").applyInPandas(paint, "y long, x long, grey int")


# ---------------------------------------------------------------- reports


def report_lines(paths: DataFrame, circles: DataFrame) -> DataFrame:
    """ord, line: what a drawing holds, pass by pass and in sum."""
    t = totals(paths, circles)
    name = F.coalesce("layer", F.lit("whole drawing"))
    line = F.concat_ws(", ", F.concat(name, F.lit(": "), F.col("paths"), F.lit(" paths")), F.concat("circles", F.lit(" circles")), F.concat("vertices", F.lit(" vertices")), F.concat(F.format_string("%.0f", "run_mm"), F.lit(" mm")))
    return t.select(F.when(F.col("layer").isNull(), "~").otherwise(F.col("layer")).alias("ord"), line.alias("line"))


#: Sizes of the material test: lettering and dots, in mm.
TYPE_LADDER = (1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.2, 2.6, 3.0, 3.5, 4.0)
DOT_LADDER = (0.2, 0.3, 0.4, 0.5, 0.7, 0.9, 1.2, 1.6, 2.0, 2.6)


def test_sheet(spark: SparkSession, width: float = 200, height: float = 150) -> tuple[DataFrame, DataFrame]:
    """(texts, circles) of a sheet that shows what a material can hold: figures in falling size, dots in rising size."""
    texts, y = [], height - 32.0
    for size in TYPE_LADDER:
        texts += [(f"{size:.1f}", 8.0, y - size, 0.0, 1.6), ("77.5", 20.0, y - size, 0.0, size), ("104.25", 38.0, y - size, 0.0, size)]
        y -= size * 1.9 + 1.4
    dots = [("DLF-02_score_medium", "test", None, 100.0 + 9 * i, height - 40.0, d / 2) for i, d in enumerate(DOT_LADDER)]
    return spark.createDataFrame(texts, "text string, x double, y double, angle double, size double"), spark.createDataFrame(dots, "layer string, kind string, sheet string, x double, y double, radius double")


def pixels_per_mm(dpi: float) -> float:
    return dpi / 25.4


