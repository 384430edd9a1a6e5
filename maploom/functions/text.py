"""Number and label text, and the small parsers of names and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_number(v: Column, decimals: int = 6) -> Column:
    """Without exponent and without trailing zeros; 0 for null and what isn't finite."""
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e21)
    s = F.format_string(f"%.{decimals}f", F.when(finite, v).otherwise(F.lit(0.0)))
    s = F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")
    return F.when(s.isin("-0", ""), "0").otherwise(s)


def level_text(level: Column, decimals: Column) -> Column:
    """A level with 0 to 3 decimals."""
    out = F.format_string("%.3f", level)
    for d in (2, 1, 0):
        out = F.when(decimals == d, F.format_string(f"%.{d}f", level)).otherwise(out)
    return out


def xml_escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def srs_of(name: Column) -> tuple[Column, Column]:
    """(EPSG label, whether the reference is in urn form) of a spatial reference name; the last number counts."""
    numbers = F.regexp_extract_all(name, F.lit("([0-9]+)"), 1)
    return F.when(F.size(numbers) > 0, F.concat(F.lit("EPSG:"), F.element_at(numbers, -1))), F.trim(name).rlike(r"(?i)^(urn:|http://www\.opengis\.net/def/crs/)")


def latitude_first(name: Column) -> Column:
    epsg, urn = srs_of(name)
    return F.coalesce(urn & epsg.isin("EPSG:4326", "EPSG:4258", "EPSG:4979", "EPSG:4269"), F.lit(False))


def prj_label(wkt: Column) -> tuple[Column, Column]:
    """(name, EPSG label) of a projection file; the last authority counts, else the last id."""
    name = F.regexp_extract(wkt, r'(?i)^\s*(?:PROJCS|GEOGCS|PROJCRS|GEOGCRS)\s*\[\s*"([^"]+)"', 1)
    auth = F.regexp_extract_all(wkt, F.lit(r'(?i)AUTHORITY\s*\[\s*"EPSG"\s*,\s*"?([0-9]+)"?\s*\]'), 1)
    ids = F.regexp_extract_all(wkt, F.lit(r'(?i)\bID\s*\[\s*"EPSG"\s*,\s*([0-9]+)\s*\]'), 1)
    code = F.when(F.size(auth) > 0, F.element_at(auth, -1)).when(F.size(ids) > 0, F.element_at(ids, -1))
    return F.nullif(name, F.lit("")), F.concat(F.lit("EPSG:"), code)


def degrees_of(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Decimal degrees; null unless the hemisphere is N, S, E or W."""
    v = d + m / 60 + s / 3600
    return F.when(ref.isin("S", "W"), -v).when(ref.isin("N", "E"), v)


def bearing(v: Column) -> Column:
    return F.pmod(v, F.lit(360.0))


def stem_and_extension(path: Column) -> tuple[Column, Column]:
    """(stem, extension) of a file name, both in lower case; files of one stem belong together."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.([^.]*)$", 1)


def route_of(path: Column) -> Column:
    """Which reader a file goes to."""
    ext = stem_and_extension(path)[1]
    return (F.when(ext.isin("tif", "tiff"), "raster").when(ext.isin("shp", "shx", "dbf", "prj", "cpg", "gml"), "features")
            .when(ext == "xml", "sniff").when(ext.isin("jpg", "jpeg"), "photo").when(ext == "png", "image").otherwise("unknown"))


def natural_key(name: Column) -> Column:
    """Sorts numbers inside names by value: array of (text, number) parts."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([^0-9]*)([0-9]*)"), 0)
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^([^0-9]*)", 1).alias("text"), F.coalesce(F.nullif(F.regexp_extract(p, "([0-9]+)$", 1), F.lit("")).try_cast("decimal(38,0)"), F.lit(-1)).alias("number")))


def table_field(raw: Column, kind: str) -> Column:
    """One field of a fixed-width table by its type letter; blanks and nonsense are null."""
    s = F.trim(F.replace(raw, F.lit("\0"), F.lit("")))
    if kind in "NFOIB":
        v = s.try_cast("double")
        return F.when(F.isnan(v) | F.isnull(v) | s.rlike("(?i)^[+-]?(nan|inf)"), F.lit(None)).otherwise(v)
    if kind == "L":
        return F.when(s.rlike("^[YyTt]$"), True).when(s.rlike("^[NnFf]$"), False)
    if kind == "D":
        return F.when(s.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)))
    return s


def ordinates(text: Column, dimension: Column) -> Column:
    """Numbers of a coordinate list; of three-dimensional ones each third is dropped; empty if anything isn't a number."""
    parts = F.filter(F.split(F.trim(text), r"[\s,]+"), lambda t: t != "")
    nums = F.transform(parts, lambda t: t.try_cast("double"))
    flat = F.when(dimension == 3, F.filter(nums, lambda v, i: i % 3 < 2)).otherwise(nums)
    return F.when(F.exists(nums, lambda v: v.isNull()), F.array().cast("array<double>")).otherwise(flat)


def no_data(z: Column, declared: Column | None = None) -> Column:
    """z, or null where the number stands for no measurement."""
    bad = F.isnan(z) | (F.abs(z) > 1e30) | z.isin(-9999.0, -32768.0, -32767.0)
    if declared is not None:
        bad = bad | F.coalesce(z == declared, F.lit(False))
    return F.when(~bad, z)
