"""Single-stroke lettering, and labels along contours."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.functions import shapes
from maploom.operators import kernels
from maploom.operators.paths import per_path

ADVANCE, ADVANCE_SPACE = 65, 42
# Strokes of each glyph on a body 100 high, strokes apart by |, points by blanks.
GLYPHS = {
    "0": "5,25 5,75 25,100 45,75 45,25 25,0 5,25",
    "1": "8,78 25,100 25,0|8,0 42,0",
    "2": "5,78 25,100 45,78 45,62 5,0 45,0",
    "3": "5,85 25,100 45,85 45,68 27,57|27,57 45,45 45,15 25,0 5,13",
    "4": "36,0 36,100 5,32 45,32",
    "5": "45,100 8,100 6,56 25,64 45,48 45,15 25,0 5,13",
    "6": "45,82 25,100 8,72 5,25 25,0 45,20 45,40 25,55 7,47",
    "7": "5,100 45,100 20,0",
    "8": "25,55 8,68 8,87 25,100 42,87 42,68 25,55 8,42 5,15 25,0 45,15 42,42 25,55",
    "9": "5,18 25,0 42,28 45,75 25,100 8,75 8,58 25,45 45,58",
    "A": "5,0 25,100 45,0|13,35 37,35",
    "B": "8,0 8,100 33,100 45,85 45,63 30,52 8,52|30,52 45,40 45,15 33,0 8,0",
    "C": "45,80 28,100 12,85 8,55 8,40 12,18 28,0 45,20",
    "D": "8,0 8,100 28,100 43,80 45,45 30,0 8,0",
    "E": "45,100 8,100 8,0 45,0|8,52 36,52",
    "F": "45,100 8,100 8,0|8,52 36,52",
    "G": "45,80 28,100 12,85 8,55 8,40 12,18 28,0 45,18 45,45 28,45",
    "H": "8,100 8,0|45,100 45,0|8,52 45,52",
    "I": "25,100 25,0|10,100 40,100|10,0 40,0",
    "J": "40,100 40,22 30,2 15,2 6,20",
    "K": "8,100 8,0|45,100 10,45|22,60 45,0",
    "L": "8,100 8,0 45,0",
    "M": "5,0 5,100 25,45 45,100 45,0",
    "N": "8,0 8,100 45,0 45,100",
    "O": "8,30 8,70 25,100 42,70 42,30 25,0 8,30",
    "P": "8,0 8,100 33,100 45,85 45,65 33,50 8,50",
    "Q": "8,30 8,70 25,100 42,70 42,30 25,0 8,30|30,20 47,-8",
    "R": "8,0 8,100 33,100 45,85 45,65 33,50 8,50|30,50 45,0",
    "S": "45,85 28,100 12,90 10,68 40,45 42,20 28,0 8,15",
    "T": "5,100 45,100|25,100 25,0",
    "U": "8,100 8,25 22,0 32,0 45,25 45,100",
    "V": "5,100 25,0 45,100",
    "W": "3,100 14,0 25,60 36,0 47,100",
    "X": "6,100 45,0|45,100 6,0",
    "Y": "6,100 25,52 45,100|25,52 25,0",
    "Z": "6,100 45,100 6,0 45,0",
    ".": "22,0 30,0 30,8 22,8 22,0",
    ",": "30,8 30,0 22,0 22,8 30,8 24,-12",
    "-": "8,50 42,50",
    "+": "8,50 42,50|25,33 25,67",
    "/": "5,0 45,100",
    ":": "22,18 30,18 30,26 22,26 22,18|22,60 30,60 30,68 22,68 22,60",
    "(": "35,100 15,70 15,30 35,0",
    ")": "15,100 35,70 35,30 15,0",
    "°": "16,78 16,92 30,92 30,78 16,78",
    "×": "12,72 38,36|38,72 12,36",
    " ": "",
}
#: Letterings: stretch, slant.
LETTERINGS = {"regular": (1.0, 0.0), "condensed": (0.82, 0.0), "wide": (1.25, 0.0), "slanted": (1.0, 0.2)}


def glyph(ch: str) -> list[list[tuple[float, float]]]:
    text = GLYPHS.get(ch, GLYPHS.get(ch.upper(), ""))
    return [[tuple(map(float, p.split(","))) for p in run.split()] for run in text.split("|") if run]


def glyph_table(spark: SparkSession) -> DataFrame:
    """ch, stroke, pts, top, bottom: the dimension table of the lettering; a glyph without strokes has a null one."""
    rows = []
    for ch in [*GLYPHS, *(c.lower() for c in GLYPHS if c.lower() not in GLYPHS)]:
        runs = glyph(ch)
        rows += [(ch, i, [{"x": x, "y": y} for x, y in run], max(y for _, y in run), min(y for _, y in run)) for i, run in enumerate(runs)]
    return spark.createDataFrame(rows, "ch string, stroke int, pts " + shapes.POINTS + ", top double, bottom double")


def characters(texts: DataFrame, keep: Sequence[str], tracking: float = 0, lettering: str = "regular", text: str = "text") -> DataFrame:
    """keep, pos, ch, pen, width: each character, where the pen stands before it, and the width of the whole, on a body of 100."""
    sx = LETTERINGS.get(lettering, LETTERINGS["regular"])[0]
    step = lambda ch: F.when(ch == " ", ADVANCE_SPACE * sx).otherwise(ADVANCE * sx) + tracking
    chars = F.filter(F.split(F.col(text), ""), lambda c: c != "")
    before = lambda i: F.aggregate(F.slice("_c", 1, i), F.lit(0.0), lambda s, c: s + step(c))
    whole = F.aggregate("_c", F.lit(0.0), lambda s, c: s + step(c)) - tracking
    rows = texts.withColumn("_c", chars).where(F.size("_c") > 0).withColumn("width", whole)
    return rows.select(*keep, "width", "_c", F.posexplode("_c").alias("pos", "ch")).select(*keep, "pos", "ch", before(F.col("pos")).alias("pen"), "width")


def text_strokes(texts: DataFrame, keep: Sequence[str], size: float = 10, tracking: float = 0, anchor: str = "start", baseline: str = "base", lettering: str = "regular") -> DataFrame:
    """keep, pos, stroke, pts: the strokes of texts (keep..., text, x, y, angle); characters without a glyph are left blank."""
    sx, slant = LETTERINGS.get(lettering, LETTERINGS["regular"])
    k = size / 100
    own = [*keep, *(c for c in ("x", "y", "angle") if c not in keep)]
    chars = characters(texts, own, tracking, lettering)
    rows = chars.join(F.broadcast(glyph_table(texts.sparkSession)), "ch")
    ox = {"middle": -F.col("width") / 2, "end": -F.col("width")}.get(anchor, F.lit(0.0))
    oy = {"middle": -50.0, "cap": -100.0}.get(baseline, 0.0)
    c, s = F.cos("angle"), F.sin("angle")

    def place(p):
        gx, gy = (p["x"] * sx + p["y"] * slant + F.col("pen") + ox) * k, (p["y"] + oy) * k
        return shapes.point(F.col("x") + gx * c - gy * s, F.col("y") + gx * s + gy * c)

    return rows.select(*keep, "pos", "stroke", F.transform("pts", place).alias("pts"))


def measure(texts: DataFrame, keep: Sequence[str], size: float = 10, tracking: float = 0, lettering: str = "regular") -> DataFrame:
    """keep, width, height, top, bottom of texts (keep..., text)."""
    chars = characters(texts, keep, tracking, lettering)
    by = F.broadcast(glyph_table(texts.sparkSession).groupBy("ch").agg(F.max("top").alias("top"), F.min("bottom").alias("bottom")))
    k = size / 100
    rows = chars.join(by, "ch", "left").groupBy(*keep).agg((F.first("width") * k).alias("width"), (F.coalesce(F.max("top"), F.lit(0.0)) * k).alias("top"), (F.coalesce(F.min("bottom"), F.lit(0.0)) * k).alias("bottom"))
    return rows.select(*keep, "width", (F.col("top") - F.col("bottom")).alias("height"), "top", "bottom")


def text_size(text: str, size: float, tracking: float = 0, lettering: str = "regular") -> tuple[float, float]:
    """(width, height) of a plain string."""
    sx = LETTERINGS[lettering][0]
    width = sum((ADVANCE_SPACE if c == " " else ADVANCE) * sx + tracking for c in text) - (tracking if text else 0)
    ys = [y for c in text for run in glyph(c) for _, y in run]
    return width * size / 100, (max(ys) - min(ys)) * size / 100 if ys else 0.0


def level_label(level: float, interval: float) -> str:
    decimals = max(0, min(3, math.ceil(-math.log10(interval) - 1e-9))) if interval > 0 else 3
    return f"{level:.{decimals}f}"


_BOX = "struct<cx: double, cy: double, hw: double, hh: double, angle: double>"


def place_labels(paths: DataFrame, interval: float, keep: Sequence[str], every: int = 5, size: float = 2.2, spacing: float = 60, clearance: float | None = None, max_deviation: float | None = None, tangent: bool = False, tracking: float = 6, suffix: str = "", most: int = 24, index_only: bool = False) -> DataFrame:
    """keep, text, boxes for paths (keep..., level, index, closed, pts) in sheet mm: where labels stand.

    Labelled are every n-th level, with neighbours out of step by a third of the spacing. Each place is moved a little along
    the path until the path is straight enough under the text; if it never is, that label is left out. Paths shorter than
    two and a half texts have none. boxes is empty then.
    """
    clearance = size * 0.45 if clearance is None else clearance
    stray = size * 0.35 if max_deviation is None else max_deviation

    def run(p: np.ndarray, closed: bool, row: dict):
        level = row["level"]
        nth = abs(math.floor(level / interval + 0.5))
        text = level_label(level, interval) + suffix
        wanted = bool(row["index"]) if index_only else nth % max(1, every) == 0
        width, height = text_size(text, size, tracking)
        line = kernels.closed_up(p) if closed else p
        s = kernels.arcs(line)
        total = float(s[-1])
        if not wanted or total <= width * 2.5:
            yield text, []
            return
        half, boxes = width / 2 + clearance, []
        n = min(most, max(1, int(total // max(spacing, width * 2))))
        gap = total / n

        def spot(at):
            at = at % total if closed else at
            return np.array([np.interp(at, s, line[:, 0]), np.interp(at, s, line[:, 1])])

        def fits(at):
            if not closed and (at - half < 0 or at + half > total):
                return False
            q = np.array([spot(at - half + 2 * half * i / 8) for i in range(9)])
            d = q[-1] - q[0]
            far = np.hypot(*d)
            return far > 0 and np.abs((q[1:-1, 0] - q[0, 0]) * d[1] - (q[1:-1, 1] - q[0, 1]) * d[0]).max() / far <= stray

        for k in range(n):
            at = nth % 3 * (spacing / 3) + gap * (k + 0.5)
            if not closed and (at < width or at > total - width):
                continue
            best = next((at + gap * d for d in (0, 0.12, -0.12, 0.24, -0.24, 0.36, -0.36) if fits(at + gap * d)), None)
            if best is None:
                continue
            angle = 0.0
            if tangent:
                i = min(max(int(np.searchsorted(s, best % total if closed else best, "right")) - 1, 0), len(line) - 2)
                d = line[i + 1] - line[i]
                angle = math.atan2(d[1], d[0])
                angle += math.pi if angle < -math.pi / 2 else -math.pi if angle > math.pi / 2 else 0
            x, y = spot(best)
            boxes.append({"cx": float(x), "cy": float(y), "hw": half, "hh": max(size, height) / 2 + clearance, "angle": angle})
        yield text, boxes

    return per_path(paths, keep, f"text string, boxes array<{_BOX}>", run)


#: A stroke's weight as a share of the lettering's size, and the width that the beam burns by itself, in mm.
WEIGHT, BURNT_MM = 0.12, 0.3


def letter_weight(size: float) -> float:
    """How much wider than the beam's own line the strokes of a size are; nothing under a second line's width."""
    extra = size * WEIGHT - BURNT_MM
    return extra if extra >= BURNT_MM else 0.0


def lettered(texts: DataFrame, keep: Sequence[str], size: float, extra: float | None = None, **how) -> DataFrame:
    """keep, pos, stroke, closed, pts: strokes; those to be wider than the beam's line by 0.3 mm or more, as letter_weight asks
    for unless extra is given, are outlined as bands and filled."""
    extra = letter_weight(size) if extra is None else extra
    rows = text_strokes(texts, keep, size, **how)
    if extra < BURNT_MM:
        return rows.select(*keep, "pos", "stroke", F.lit(False).alias("closed"), "pts")

    def run(p, closed, row):
        rings = kernels.band(p, extra, False)
        for ring, _ in rings:
            yield True, ring
        for line in kernels.band_fill(p, extra, BURNT_MM, False) if rings else [p]:
            yield False, line

    return per_path(rows, [*keep, "pos", "stroke"], "closed boolean, pts " + shapes.POINTS, run)
