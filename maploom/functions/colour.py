"""Pixel channels, and the passes of the machine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _luminance(r: Column, g: Column, b: Column) -> Column:
    return (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255


def _saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top > 0, (top - F.least(r, g, b)) / top).otherwise(F.lit(0.0))


#: name: 0 to 1 from red, green and blue of 0 to 255
CHANNELS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "luminance": _luminance,
    "greenness": lambda r, g, b: F.least(F.greatest((2 * g - r - b) / 255 * 0.5 + 0.5, F.lit(0.0)), F.lit(1.0)),
    "brightness": lambda r, g, b: F.greatest(r, g, b) / 255,
    "saturation": _saturation,
    "darkness": lambda r, g, b: 1 - _luminance(r, g, b),
    "red": lambda r, g, b: r / 255,
    "green": lambda r, g, b: g / 255,
    "blue": lambda r, g, b: b / 255,
}
#: Channels that mean something to the eye; the raw bands don't.
RECOMMENDED = ("luminance", "greenness", "brightness", "saturation", "darkness")

# Pass, colour number, red, green, blue, grey when engraved, whether the machine cuts.
PASSES = (
    ("DLF-00_engrave", 7, 0, 0, 0, 0.35, False, "0 · engrave (black)"),
    ("DLF-01_score_light", 5, 0, 0, 255, 0.45, False, "1 · score light (blue)"),
    ("DLF-02_score_medium", 3, 0, 255, 0, 0.60, False, "2 · score medium (green)"),
    ("DLF-03_score_strong", 4, 0, 255, 255, 0.75, False, "3 · score strong (cyan)"),
    ("DLF-04_cut_inner", 6, 255, 0, 255, 0.90, True, "4 · cut inner (magenta)"),
    ("DLF-05_cut_outer", 1, 255, 0, 0, 1.00, True, "5 · cut outer (red)"),
    ("DLF-99_sheet", 8, 128, 128, 128, 0.5, False, "sheet, never cut"),
)
ENGRAVE, SHEET_PASS = PASSES[0][0], PASSES[-1][0]
CUTS = tuple(p[0] for p in PASSES if p[6])
COLOURS = {p[0]: f"#{p[2]:02x}{p[3]:02x}{p[4]:02x}" for p in PASSES}


def passes(spark: SparkSession) -> DataFrame:
    """The dimension table of passes, in machine order."""
    schema = "ord int, layer string, aci int, red int, green int, blue int, grey double, cuts boolean, label string"
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PASSES)], schema)


def pass_colour(layer: Column) -> Column:
    out = F.lit("#000000")
    for name, colour in COLOURS.items():
        out = F.when(layer == name, colour).otherwise(out)
    return out


def width_of(layer: Column, width_mm: Column) -> Column:
    """Only the engraving pass has a width."""
    return F.when((layer == ENGRAVE) & (width_mm > 0), width_mm).otherwise(F.lit(0.0))


def refuse_restricted(licence: str | None, name: str = "this image") -> None:
    """Raises unless drawings made from an image of this licence may be exported."""
    if licence == "restricted":
        raise PermissionError(f"{name} is licence-restricted, and a halftone carries its pixels; it can't be exported")
    if licence == "unknown":
        raise PermissionError(f"{name} has no licence marked; say where it came from before exporting")
