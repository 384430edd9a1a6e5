"""Shapefiles, dBASE tables and GML: features with their attributes, read and written."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from io import BytesIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.functions import shapes
from maploom.operators.kernels import area2
from maploom.sources.files import binary, parsed

_POINT, _MULTI, _LINE, _AREA = {1, 11, 21}, {8, 18, 28}, {3, 13, 23}, {5, 15, 25}


# ---------------------------------------------------------------- shapefile


def shape_records(data: bytes, name: str = "the file", min_points: int = 3, keep_closure: bool = False) -> Iterator[tuple[int, str, int, bool, list[dict]]]:
    """(ord, kind, part, hole, pts) of each part of each record; ord is the record's place, null shapes included.

    A repeated last point is dropped, and parts of fewer than min_points points are passed over. Of areas, counter-clockwise
    parts are holes, but for a sole part.
    """
    if len(data) < 100:
        raise ValueError(f"only {len(data)} bytes; the header of a .shp alone has 100")
    if struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("not a .shp: its signature is missing")
    kind_of = struct.unpack_from("<i", data, 32)[0]
    if kind_of not in _POINT | _MULTI | _LINE | _AREA:
        raise ValueError(f"holds shapes of type {kind_of}, which can't be read")
    kind = "point" if kind_of in _POINT | _MULTI else "line" if kind_of in _LINE else "polygon"
    words = struct.unpack_from(">i", data, 24)[0]
    end = min(len(data), words * 2) if words * 2 > 100 else len(data)
    found, at, record = [], 100, 0
    while at + 8 <= end:
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        body = at + 8
        if size <= 0 or body + size > end:
            break
        st = struct.unpack_from("<i", data, body)[0]
        if st in _POINT:
            x, y = struct.unpack_from("<2d", data, body + 4)
            found.append((record, "point", 0, False, [{"x": x, "y": y}]))
        elif st in _MULTI:
            n = struct.unpack_from("<i", data, body + 36)[0]
            v = struct.unpack_from(f"<{2 * n}d", data, body + 40)
            found += [(record, "point", i, False, [{"x": v[2 * i], "y": v[2 * i + 1]}]) for i in range(n)]
        elif st in _LINE | _AREA:
            parts, n = struct.unpack_from("<2i", data, body + 36)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), n]
            v = struct.unpack_from(f"<{2 * n}d", data, body + 44 + 4 * parts)
            for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
                pts = [(v[2 * k], v[2 * k + 1]) for k in range(a, b)]
                if len(pts) < min_points:
                    continue
                if not keep_closure and pts[0] == pts[-1]:
                    pts = pts[:-1]
                if len(pts) < min_points:
                    continue
                found.append((record, kind, i, kind == "polygon" and area2(np.array(pts)) > 0, [{"x": x, "y": y} for x, y in pts]))
        record += 1
        at = body + size
    if not found:
        raise ValueError("every shape is empty or has too few points")
    if kind == "polygon" and len(found) == 1:
        found = [(*found[0][:3], False, found[0][4])]
    yield from found


SHAPES = "ord long, kind string, part int, hole boolean, pts " + shapes.POINTS


def read_shapes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parsed(binary(spark, path), shape_records, SHAPES)


def write_shapes(parts: list[list[tuple[float, float]]], kind: int) -> tuple[bytes, bytes]:
    """(.shp, .shx) of points (1) or of lines (3), one part a record."""
    every = [p for part in parts for p in part]
    box = (min(x for x, _ in every), min(y for _, y in every), max(x for x, _ in every), max(y for _, y in every)) if every else (0.0,) * 4
    body, index, offset = b"", b"", 50
    for i, part in enumerate(parts):
        if kind == 1:
            content = struct.pack("<i2d", 1, *part[0])
        else:
            xs, ys = [x for x, _ in part], [y for _, y in part]
            content = struct.pack("<i4d3i", kind, min(xs), min(ys), max(xs), max(ys), 1, len(part), 0) + b"".join(struct.pack("<2d", *p) for p in part)
        words = len(content) // 2
        index += struct.pack(">2i", offset, words)
        body += struct.pack(">2i", i + 1, words) + content
        offset += 4 + words
    head = lambda size: struct.pack(">i20xi", 9994, size // 2) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0)
    return head(100 + len(body)) + body, head(100 + len(index)) + index


# ---------------------------------------------------------------- dBASE


def table_fields(data: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type, length, decimals) of each field."""
    if len(data) < 33:
        raise ValueError(f"only {len(data)} bytes; a dBASE header alone has 32")
    head, size = struct.unpack_from("<2h", data, 8)
    if head < 33 or size < 1:
        raise ValueError(f"an impossible header: header {head} bytes, record {size} bytes")
    out = []
    for at in range(32, head - 1, 32):
        if data[at] in (0, 13):
            break
        out.append((data[at : at + 11].split(b"\0")[0].decode("latin-1").strip(), chr(data[at + 11]), data[at + 16], data[at + 17]))
    if not out:
        raise ValueError("declares no fields")
    return out


def field_value(raw: str, kind: str):
    """One value; blanks and nonsense are null."""
    s = raw.replace("\0", "").strip()
    if kind in "NFOIB":
        try:
            v = float(s)
        except ValueError:
            return None
        return v if v == v and abs(v) != float("inf") else None
    if kind == "L":
        return True if s in tuple("YyTt") else False if s in tuple("NnFf") else None
    if kind == "D":
        return f"{s[:4]}-{s[4:6]}-{s[6:]}" if re.fullmatch(r"\d{8}", s, re.ASCII) else None
    return s


def table_records(data: bytes, name: str = "the table") -> Iterator[tuple[int, bool, dict]]:
    """(physical place, deleted, values) of each record that is there, whatever number the header claims."""
    fields = table_fields(data)
    n, head, size = struct.unpack_from("<i2h", data, 4)
    for r in range(n):
        at = head + r * size
        if at + size > len(data):
            return
        row, off = {}, at + 1
        for f, kind, length, _ in fields:
            row[f] = field_value(data[off : off + length].decode("latin-1"), kind)
            off += length
        yield r, data[at] == 0x2A, row


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """ord and one typed column a field, of the records that aren't deleted; ord counts those, as shapes are counted.

    The columns come from the header, which alone is read on the driver.
    """
    head = binary(spark, path).select(F.substring("content", 1, 32 * 257)).first()[0]
    fields = table_fields(bytes(head))
    kinds = {"L": "boolean", "N": "double", "F": "double", "O": "double", "I": "double", "B": "double"}
    schema = ", ".join(["ord long", *(f"`{f}` {kinds.get(k, 'string')}" for f, k, _, _ in fields)])

    def parse(data: bytes, name: str):
        ord_ = 0
        for _, deleted, row in table_records(data, name):
            if not deleted:
                yield (ord_, *(row[f] for f, *_ in fields))
                ord_ += 1

    return parsed(binary(spark, path), parse, schema.replace("`", "")).drop("path")


def measured_fields(table: DataFrame) -> DataFrame:
    """field, n of the numeric columns that hold any number."""
    names = [f.name for f in table.schema if f.dataType.simpleString() == "double"]
    if not names:
        return table.sparkSession.createDataFrame([], "field string, n long")
    one = table.agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").alias("n")) for n in names])).alias("f")).select("f.*").where("n > 0")


def field_range(rows: DataFrame, field: str) -> DataFrame:
    """lo, hi, n, missing; zeros if nothing was measured."""
    return rows.agg(F.coalesce(F.min(field).cast("double"), F.lit(0.0)).alias("lo"), F.coalesce(F.max(field).cast("double"), F.lit(0.0)).alias("hi"), F.count(field).alias("n"), (F.count("*") - F.count(field)).alias("missing"))


def write_table(fields: list[tuple[str, str, int, int]], rows: list[dict], date: tuple[int, int, int] = (126, 1, 1)) -> bytes:
    size = 1 + sum(f[2] for f in fields)
    head = struct.pack("<4Bi2h20x", 3, *date, len(rows), 32 + 32 * len(fields) + 1, size)
    for name, kind, length, decimals in fields:
        head += name[:10].upper().encode("latin-1", "replace").ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([length, decimals]) + b"\0" * 14

    def text(v, kind, length, decimals):
        s = "" if v is None else ("T" if v else "F") if kind == "L" else f"{float(v):.{decimals}f}" if kind == "N" else str(v)
        return (s.rjust(length) if kind == "N" else s.ljust(length))[:length].encode("latin-1", "replace")

    body = b"".join(b" " + b"".join(text(row.get(f), k, n, d) for f, k, n, d in fields) for row in rows)
    return head + b"\r" + body + b"\x1a"


# ---------------------------------------------------------------- GML

_AREAL = ("Polygon", "Surface", "MultiSurface", "MultiPolygon")
_LINEAL = ("LineString", "Curve", "MultiCurve", "MultiLineString", "LinearRing")
_PUNCTUAL = ("Point", "MultiPoint")
_GEOMETRY = {*_AREAL, *_LINEAL, *_PUNCTUAL, "MultiGeometry"}


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1] if isinstance(tag, str) else ""


def _inside(el, *names: str) -> list:
    return [x for x in el.iter() if x is not el and _local(x.tag) in names]


def _attr(el, name: str) -> str | None:
    return next((v for k, v in el.attrib.items() if _local(k) == name), None)


def _ordinates(el) -> list[tuple[float, float]]:
    """The points of a posList, pos or coordinates element; none if anything isn't a number."""
    if _local(el.tag) == "coordinates":
        cs, ts, dec = _attr(el, "cs") or ",", _attr(el, "ts") or " ", _attr(el, "decimal") or "."
        out = []
        for tuple_ in re.split(f"[{re.escape(ts)}\\s]+", (el.text or "").strip().replace(dec, ".")):
            parts = tuple_.split(cs)
            try:
                out.append((float(parts[0]), float(parts[1])))
            except (ValueError, IndexError):
                continue
        return out
    dim = int(float(_attr(el, "srsDimension") or _attr(el, "dimension") or 0))
    try:
        v = [float(t) for t in re.split(r"[\s,]+", (el.text or "").strip()) if t]
    except ValueError:
        return []
    step = 3 if dim == 3 else 2
    return [(v[i], v[i + 1]) for i in range(0, len(v) - 1, step)]


def _runs(el) -> list[list[tuple[float, float]]]:
    out = [p for x in _inside(el, "posList", "coordinates") if len(p := _ordinates(x)) > 1]
    if not out and len(pts := [p for x in _inside(el, "pos") for p in _ordinates(x)]) > 1:
        out = [pts]
    return out


def feature_geometry(el) -> tuple[str, list[tuple[bool, list]]] | None:
    """(kind, [(hole, points)]): areas if there are any, else lines, else points."""
    for tag in _AREAL:
        rings = []
        for g in _inside(el, tag):
            loops = _inside(g, "LinearRing")
            holes = {id(r) for h in _inside(g, "interior", "innerBoundaryIs") for r in _inside(h, "LinearRing")}
            rings += [(id(r) in holes, p) for r in loops or [g] for p in _runs(r) if len(p) > 2]
        if rings:
            return "polygon", rings
    for tag in _LINEAL:
        if lines := [(False, p) for g in _inside(el, tag) for p in _runs(g)]:
            return "line", lines
    for tag in _PUNCTUAL:
        pts = []
        for g in _inside(el, tag):
            for one in _inside(g, "Point") or [g]:
                if xy := [p for x in _inside(one, "pos", "coordinates") for p in _ordinates(x)][:1]:
                    pts.append((False, xy))
        if pts:
            return "point", pts
    return None


def feature_attributes(el) -> dict[str, str]:
    """Texts of the children that are values, by upper-case name."""
    return {_local(c.tag).upper(): c.text.strip() for c in el if _local(c.tag) not in _GEOMETRY and not len(c) and (c.text or "").strip()}


def gml_features(data: bytes, name: str = "the file") -> Iterator[tuple]:
    """(ord, kind, part, hole, pts, props, srs) of each part; features without a geometry that can be read are passed over."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError as e:
        raise ValueError(f"not XML that can be followed: {e}") from e
    srs = next((v for el in root.iter() if (v := _attr(el, "srsName"))), None)
    numbers = re.findall(r"\d+", srs or "")
    swap = bool(numbers) and bool(re.match(r"(?i)urn:|http://www\.opengis\.net/def/crs/", srs.strip())) and numbers[-1] in ("4326", "4258", "4979", "4269")
    members = [c for m in _inside(root, "featureMember", "featureMembers", "member") for c in m]
    members = members or [c for c in root if _local(c.tag) not in _GEOMETRY] or [root]
    for ord_, el in enumerate(members):
        got = feature_geometry(el)
        if got is None:
            continue
        for part, (hole, pts) in enumerate(got[1]):
            yield ord_, got[0], part, hole, [{"x": y, "y": x} if swap else {"x": x, "y": y} for x, y in pts], feature_attributes(el), srs


GML = "ord long, kind string, part int, hole boolean, pts " + shapes.POINTS + ", props map<string, string>, srs string"


def read_gml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parsed(binary(spark, path), gml_features, GML)


def numeric_properties(features: DataFrame) -> DataFrame:
    """kind, field of the properties whose present values are all numbers."""
    rows = features.select("kind", F.explode("props").alias("field", "value"))
    number = F.col("value").rlike(r"^[-+0-9.eE]+$") & F.col("value").try_cast("double").isNotNull()
    return rows.groupBy("kind", "field").agg(F.bool_and(number).alias("ok")).where("ok").select("kind", "field")


# ---------------------------------------------------------------- archives


def stored_zip(files: list[tuple[str, bytes]]) -> bytes:
    """A ZIP that only stores, the same bytes for the same files."""
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()
