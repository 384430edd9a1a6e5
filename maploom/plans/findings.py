"""What a drawing's stages found: counts and verdicts for the person at the machine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.functions.frames import Sheet
from maploom.functions.scales import budget
from maploom.operators import features, paths, regions, sampling, symbols
from maploom.plans.compile import NOTES, Inputs, assembled, attributed, clip_rings, merged, resolve
from maploom.plans.storage import stored
from maploom.sources.sinks import report_lines

#: Circles beyond which the machine is busy for long.
MOST_CIRCLES = 4000


def _rows(df: DataFrame, stage: str, notes: dict[str, Column] | None = None) -> DataFrame:
    """stage, what, n, note: a one-row table turned, a column a finding."""
    notes = notes or {}
    each = [F.struct(F.lit(name).alias("what"), F.col(name).cast("double").alias("n"), notes.get(name, F.lit(None)).cast("string").alias("note")) for name in df.columns]
    return df.select(F.explode(F.array(*each)).alias("f")).select(F.lit(stage).alias("stage"), "f.*")


def findings(spark: SparkSession, inputs: Inputs, spec: dict | None = None) -> DataFrame:
    """stage, what, n, note: what each stage that is switched on draws, leaves out and warns of.

    Every finding is an aggregate; nothing is collected. An empty raster gives counts of zero and null figures.
    """
    s, f = merged(spec), inputs.frame
    sheet = Sheet(f, s["sheet"]["scale"], s["sheet"]["margin"])
    out = [_rows(inputs.cells.agg(F.count("*").alias("cells"), F.count("z").alias("measured")), "raster")]

    h = s["halftone"]
    if h["enabled"] and inputs.pixels is not None:
        dots = symbols.halftone(inputs.pixels, *inputs.image_size, inputs.image_at(), h["across"], (h["channel"],))
        drawn = F.col("radius") * sheet.mm_per_unit >= h["min_radius_mm"]
        marks, verdict = budget(F.lit(h["across"]), F.lit(inputs.image_size[1] / inputs.image_size[0]))
        out.append(_rows(dots.agg(F.count_if(drawn).alias("marks"), F.count_if(~drawn).alias("too small")).withColumn("budget", marks), "halftone", {"budget": verdict}))

    if s["photos"]["enabled"] and inputs.photos is not None:
        placed = features.place_photos(inputs.photos, inputs.cells, f)
        at = placed.agg(F.count_if("inside").alias("drawn"), F.count_if(~F.col("inside")).alias("outside"))
        lost = inputs.photos.agg(F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("without a place"))
        out.append(_rows(at.join(lost).withColumn("doubt in mm", F.lit(sheet.doubt_mm())), "photos"))

    r = s["regions"]
    if r["enabled"]:
        surface = resolve(r["source"], inputs)
        found = regions.region_summary(regions.regions(surface, f, r["threshold"], r["min_area"]))
        rings = regions.region_rings(surface, f, r["threshold"], r["min_area"]).agg(F.count("*").alias("rings"))
        warn = F.when(F.col("regions") == 0, "nothing exceeds the threshold").when(F.lit(r["mode"] == "window"), "cut through the surface: what lies inside goes with the offcut")
        out.append(_rows(found.join(rings), "regions", {"regions": warn}))

    y = s["symbols"]
    if y["enabled"]:
        stride = max(1, int(max(f.nrows, f.ncols) / max(4, y["across"]) + 0.5))
        dots = symbols.symbol_field(resolve(y["source"], inputs), f, stride)
        dots = dots.withColumn("x", sheet.x(F.col("x"))).withColumn("y", sheet.y(F.col("y"))).withColumn("radius", sheet.length(F.col("radius")))
        whole = symbols.on_sheet(dots, sheet.width, sheet.height).agg(F.count("*").alias("circles"), (2 * F.min("radius")).alias("smallest"), (2 * F.max("radius")).alias("largest"))
        every = dots.agg(F.count("*").alias("_n"))
        note = {"circles": F.when(F.col("circles") > MOST_CIRCLES, "many circles: a coarser grid is faster"), "dropped": F.when(F.col("dropped") > 0, F.lit(f"a cut circle would read as a smaller value; {NOTES.get(y['source'], '')}".rstrip("; ")))}
        out.append(_rows(whole.join(every).withColumn("dropped", F.col("_n") - F.col("circles")).drop("_n"), "symbols", note))

    q = s["sections"]
    if q["enabled"]:
        cut = sampling.sections(inputs.cells, f, q["count"], q["axis"], shared=q["shared"])
        one = cut.groupBy("section").agg(F.max("run").alias("runs"), F.min("exaggeration").alias("exaggeration"), F.count("v").alias("v"))
        have = F.col("v") > 0
        apart = (f.height if q["axis"] != "vertical" else f.width) / (max(1, min(24, round(q["count"]))) + 1)
        tall = f.cell * 8 > apart and q["count"] > 1
        row = one.agg(F.count_if(have).alias("cuts"), F.coalesce(F.sum(F.when(have, F.col("runs") - 1)), F.lit(0)).alias("breaks"), F.avg(F.when(have, F.col("exaggeration"))).alias("exaggeration"))
        note = {"cuts": F.when(F.col("cuts") == 0, "no measured values along the cuts").when(F.lit(tall), "profiles are taller than the gap between cuts and overlap"),
                "breaks": F.when(F.col("breaks") > 0, "profiles stop at unmeasured ground"), "exaggeration": F.when(F.col("exaggeration") < 1, "heights are compressed: slopes read shallower than they are").otherwise("heights are exaggerated")}
        out.append(_rows(row, "sections", note))

    if s["features"]["enabled"]:
        for i, layer in enumerate(inputs.layers):
            rows = layer["rows"]
            if layer["kind"] == "point":
                on = sheet.holds(sheet.x(F.col("x")), sheet.y(F.col("y")))
            else:
                on = F.exists("pts", lambda p: sheet.holds(sheet.x(p["x"]), sheet.y(p["y"])))
            on = F.coalesce(on, F.lit(False))
            counts = [F.count_if(on).alias("drawn"), F.count_if(~on).alias("off the sheet")]
            driven = layer.get("style", {}).get("driven", {})
            if driven:
                rows = attributed(layer, layer["style"])
                counts.append(F.count_if(reduce(Column.__or__, [F.col(k).isNull() for k in driven]) & on).alias("unmeasured"))
            out.append(_rows(rows.agg(*counts), f"features {layer.get('name', i)}"))

    boundary = clip_rings(s, sheet)
    if s["clip"]["rings"] and not boundary:
        out.append(_rows(spark.range(1).select(F.lit(0).alias("applied")), "clip", {"applied": F.lit("the boundary misses the sheet: everything is kept")}))
    elif boundary:
        lines, rounds, _ = assembled(spark, inputs, spec)
        # Written, so that ids stay the same in both readings.
        lines = stored(lines.where("not furniture").withColumn("_id", F.monotonically_increasing_id()), "unclipped")
        after = paths.clip_drawing(lines, boundary, ["_id"]).groupBy("_id").agg(F.bool_and("whole").alias("whole"))
        got = lines.agg(F.count("*").alias("_all")).join(after.agg(F.count("*").alias("_kept"), F.count_if(~F.col("whole")).alias("cut")))
        circles = rounds.agg(F.count("*").alias("_rounds")).join(paths.clip_circles(rounds, boundary).agg(F.count("*").alias("_inside")))
        row = got.join(circles).select((F.col("_all") - F.col("_kept")).alias("paths dropped"), F.col("cut").alias("paths cut"), (F.col("_rounds") - F.col("_inside")).alias("circles dropped"))
        out.append(_rows(row, "clip"))
    return reduce(DataFrame.unionByName, out)


def finding_lines(found: DataFrame) -> DataFrame:
    """ord, line: findings as a report's lines, stage by stage."""
    number = F.when(F.col("n") == F.floor("n"), F.format_string("%.0f", "n")).otherwise(F.format_string("%.2f", "n"))
    line = F.concat_ws(" - ", F.concat(F.col("what"), F.lit(": "), F.coalesce(number, F.lit("none"))), "note")
    return found.select(F.concat_ws(" ", "stage", "what").alias("ord"), F.concat(F.col("stage"), F.lit(", "), line).alias("line"))


def cutting_report(spark: SparkSession, inputs: Inputs, spec: dict | None, lines: DataFrame, rounds: DataFrame) -> DataFrame:
    """part, ord, line: a drawing's findings and its totals pass by pass."""
    found = finding_lines(findings(spark, inputs, spec)).select(F.lit(0).alias("part"), "ord", "line")
    return found.unionByName(report_lines(lines, rounds).select(F.lit(1).alias("part"), "ord", "line"))
