"""Formats: what is written is read back, and what can't be read is refused by name."""

import struct
import zipfile
import zlib
from io import BytesIO

import numpy as np
import pytest

from maploom.functions.frames import Frame, Sheet
from maploom.plans import fixtures
from maploom.plans.queries import _drawing
from maploom.sources import exif, sinks, tiff, vector

RNG = np.random.default_rng(3)
GRID = (70 + 8 * np.sin(np.arange(61) / 9)[None, :] * np.cos(np.arange(47) / 7)[:, None] + 0.05 * np.arange(61)[None, :]).astype(np.float32)


def lzw(data: bytes) -> bytes:
    """Codes for data, early change included, for the decoder's tests."""
    out, bits, held = bytearray(), 0, 0
    table, width = {bytes([i]): i for i in range(256)}, 9

    def put(code, width):
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
            bits &= (1 << held) - 1

    put(256, 9)
    cur = b""
    n = 258
    for i in range(len(data)):
        ch = data[i : i + 1]
        if cur + ch in table:
            cur += ch
            continue
        put(table[cur], width)
        table[cur + ch] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            put(256, width)
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        cur = ch
    if cur:
        put(table[cur], width)
    put(257, width)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


@pytest.mark.parametrize("how", [{}, {"rows_per_strip": 5}, {"tile": 16}, {"codec": 8}, {"codec": 8, "predictor": 2, "tile": 32}, {"codec": 8, "predictor": 3, "rows_per_strip": 7}, {"codec": 32773}, {"predictor": 3, "tile": 16}])
def test_tiff_round_trip(how):
    m = tiff.read_image(tiff.write_image(GRID, cell=0.5, origin_x=500000, origin_y=7600000, code=25833, nodata="-9999", **how))
    assert np.array_equal(m.data[:, :, 0].astype(np.float32), GRID)
    assert (m.cell, m.origin_x, m.origin_y, m.crs, m.nodata, m.georeferenced) == (0.5, 500000, 7600000, "EPSG:25833", -9999, True)


@pytest.mark.parametrize("kind", ["u1", "i1", "u2", "i2", "u4", "i4", "f4", "f8"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_samples(kind, predictor):
    data = RNG.integers(0, 100, (9, 11, 3)).astype(kind)
    if predictor == 2 and kind[0] == "f":
        return
    assert np.array_equal(tiff.read_image(tiff.write_image(data, predictor=predictor)).data, data)


def test_lzw_and_packbits():
    for data in (b"", b"a", bytes(RNG.integers(0, 4, 30_000, dtype=np.uint8)), bytes(RNG.integers(0, 256, 20_000, dtype=np.uint8)), b"xy" * 9000):
        assert tiff.lzw(lzw(data), len(data)) == data
    assert tiff.packbits(b"\x02abc\xfez\x80\x00q", 7) == b"abczzzq"
    raw = zlib.compress(b"hello" * 50)
    assert tiff.inflate(raw) == b"hello" * 50 == tiff.inflate(raw[2:-4])


def test_tiff_refusals():
    good = tiff.write_image(GRID)
    for data, why in ((b"xx" + good[2:], "byte-order"), (good[:2] + struct.pack("<H", 43) + good[4:], "BigTIFF"), (good[:2] + struct.pack("<H", 41) + good[4:], "version")):
        with pytest.raises(ValueError, match=why):
            tiff.read_image(data)
    with pytest.raises(ValueError, match="not supported"):
        tiff.unpacked(7, b"", 1)
    with pytest.raises(ValueError, match="square"):
        tiff.place({33550: [1, 2, 0], 33922: [0, 0, 0, 1, 2, 0]}, 1, 1)
    with pytest.raises(ValueError, match="rotated"):
        tiff.place({34264: [1, 0.5, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1]}, 1, 1)
    assert tiff.place({}, 5, 7) == (1.0, 0.0, 7.0, False)


def test_tiff_as_cells(spark, tmp_path):
    z = GRID.copy()
    z[3, 4], z[5, 6] = np.nan, -9999
    (tmp_path / "a.tif").write_bytes(tiff.write_image(z, cell=2, code=25833))
    rows = tiff.read_elevation(spark, str(tmp_path / "a.tif"))
    got = {(r.r, r.c): r.z for r in rows.collect()}
    assert len(got) == z.size and got[3, 4] is None and got[5, 6] is None and got[0, 0] == z[0, 0]
    meta = tiff.raster_meta(spark, str(tmp_path / "a.tif")).first()
    assert (meta.nrows, meta.ncols, meta.cell, meta.crs) == (47, 61, 2.0, "EPSG:25833")
    (tmp_path / "bad.tif").write_bytes(b"nothing at all")
    with pytest.raises(Exception, match="bad.tif"):
        tiff.read_elevation(spark, str(tmp_path / "bad.tif")).count()
    (tmp_path / "rgb.tif").write_bytes(tiff.write_image(RNG.integers(0, 255, (4, 5, 3)).astype("u1")))
    assert tiff.read_ortho(spark, str(tmp_path / "rgb.tif")).count() == 20


def polygon(rings, kind=5):
    pts = [p for r in rings for p in r]
    starts = np.cumsum([0, *map(len, rings)])[:-1]
    body = struct.pack("<i4d2i", kind, 0, 0, 9, 9, len(rings), len(pts)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
    return body


def shp(records, kind):
    body = b"".join(struct.pack(">2i", i + 1, len(r) // 2) + r for i, r in enumerate(records))
    return struct.pack(">i20xi", 9994, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + body


CW = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0), (0.0, 0.0)]
CCW = [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0), (3.0, 3.0)]


def test_shapes(spark, tmp_path):
    data = shp([polygon([CW, CCW]), struct.pack("<i", 0), polygon([CW])], 5)
    (tmp_path / "a.shp").write_bytes(data)
    got = [(r.ord, r.kind, r.part, r.hole, len(r.pts)) for r in vector.read_shapes(spark, str(tmp_path / "a.shp")).orderBy("ord", "part").collect()]
    assert got == [(0, "polygon", 0, False, 4), (0, "polygon", 1, True, 4), (2, "polygon", 0, False, 4)]
    assert [r[3] for r in vector.shape_records(shp([polygon([CCW])], 5))] == [False]
    assert [r[4] for r in vector.shape_records(shp([struct.pack("<i2d", 1, 2.0, 3.0)], 1))] == [[{"x": 2.0, "y": 3.0}]]
    with pytest.raises(ValueError, match="signature"):
        list(vector.shape_records(b"\0" * 120))
    with pytest.raises(ValueError, match="only 3 bytes"):
        list(vector.shape_records(b"abc"))
    lines, index = vector.write_shapes([[(0, 0), (1, 2), (3, 3)], [(5, 5), (6, 6), (7, 5)]], 3)
    assert [len(r[4]) for r in vector.shape_records(lines)] == [3, 3] and len(index) == 100 + 16


def test_tables(spark, tmp_path):
    fields = [("SPECIES", "C", 20, 0), ("DBH", "N", 7, 1), ("ALIVE", "L", 1, 0), ("DAY", "D", 8, 0)]
    rows = [{"SPECIES": "birk", "DBH": 12.3, "ALIVE": True, "DAY": "20260611"}, {"SPECIES": "gran", "DBH": None, "ALIVE": None, "DAY": "x"}, {"SPECIES": "rogn", "DBH": 4, "ALIVE": False, "DAY": None}]
    data = bytearray(vector.write_table(fields, rows))
    (tmp_path / "t.dbf").write_bytes(bytes(data))
    got = [tuple(r) for r in vector.read_table(spark, str(tmp_path / "t.dbf")).orderBy("ord").collect()]
    assert got == [(0, "birk", 12.3, True, "2026-06-11"), (1, "gran", None, None, None), (2, "rogn", 4.0, False, None)]
    head, size = struct.unpack_from("<2h", data, 8)
    data[head + size] = 0x2A
    data[4:8] = struct.pack("<i", 99)
    assert [(r, d) for r, d, _ in vector.table_records(bytes(data))] == [(0, False), (1, True), (2, False)]
    with pytest.raises(ValueError, match="no fields|impossible"):
        vector.table_fields(bytes(64))


GML = b"""<?xml version="1.0"?><!DOCTYPE x><c:FeatureCollection xmlns:c="urn:c" xmlns:gml="http://www.opengis.net/gml" srsName="urn:ogc:def:crs:EPSG::4326">
<gml:featureMember><c:Plot><c:name>one &amp; two</c:name><c:size>4.5</c:size><c:geom><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 0 9 9 9 9 0 0 0</gml:posList></gml:LinearRing></gml:exterior>
<gml:interior><gml:LinearRing><gml:posList srsDimension="3">3 3 1 3 6 1 6 6 1 3 3 1</gml:posList></gml:LinearRing></gml:interior></gml:Polygon></c:geom></c:Plot></gml:featureMember>
<gml:featureMember><c:Path><c:size>7</c:size><gml:LineString><gml:coordinates>1,2 3,4 5,6</gml:coordinates></gml:LineString></c:Path></gml:featureMember>
<gml:featureMember><c:Tree><c:note>x</c:note><gml:Point><gml:pos>5 6</gml:pos></gml:Point></c:Tree></gml:featureMember>
<gml:featureMember><c:Ghost><c:note>nothing</c:note></c:Ghost></gml:featureMember></c:FeatureCollection>"""


def test_gml(spark, tmp_path):
    (tmp_path / "a.gml").write_bytes(GML)
    rows = vector.read_gml(spark, str(tmp_path / "a.gml"))
    got = [(r.ord, r.kind, r.part, r.hole, len(r.pts), r.props.get("SIZE")) for r in rows.orderBy("ord", "part").collect()]
    assert got == [(0, "polygon", 0, False, 5, "4.5"), (0, "polygon", 1, True, 4, "4.5"), (1, "line", 0, False, 3, "7"), (2, "point", 0, False, 1, None)]
    assert rows.where("kind = 'point'").first().pts[0].asDict() == {"x": 6.0, "y": 5.0}
    assert {(r.kind, r.field) for r in vector.numeric_properties(rows).collect()} == {("polygon", "SIZE"), ("line", "SIZE")}
    with pytest.raises(ValueError, match="not XML"):
        list(vector.gml_features(b"<a><b></a>"))


def jpeg(gps=True, ref=b"N", lat=(69, 39, 0.36), zero=False):
    def ratio(*v):
        return b"".join(struct.pack("<2I", int(round(x * 1000)), 1000) for x in v)


    def ifd(items, at):
        out, extra = struct.pack("<H", len(items)), b""
        spot = at + 2 + 12 * len(items) + 4
        for tag, kind, n, raw in items:
            if len(raw) <= 4:
                out += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
            else:
                out += struct.pack("<HHII", tag, kind, n, spot)
                extra += raw
                spot += len(raw)
        return out + b"\0\0\0\0" + extra

    first = [(0x10F, 2, 3, b"DL\0"), (0x132, 2, 20, b"2026:06:11 10:42:07\0"), (0x8825, 4, 1, struct.pack("<I", 200))] if gps else [(0x10F, 2, 3, b"DL\0")]
    body = (b"II*\0" + struct.pack("<I", 8) + ifd(first, 8)).ljust(200, b"\0")
    lat = (0, 0, 0) if zero else lat
    lon = (0, 0, 0) if zero else (18, 57, 19.08)
    body += ifd([(1, 2, 2, ref + b"\0"), (2, 5, 3, ratio(*lat)), (3, 2, 2, b"E\0"), (4, 5, 3, ratio(*lon)), (5, 1, 1, b"\x01"), (6, 5, 1, ratio(3.5)), (17, 5, 1, ratio(725.0))], 200)
    app = b"Exif\0\0" + body
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xda"


def test_photos(spark, tmp_path):
    m = exif.photo_meta(jpeg(), "a.jpg")
    assert m["lat"] == pytest.approx(69.6501) and m["lon"] == pytest.approx(18.9553) and m["alt"] == -3.5 and m["direction"] == 5.0 and m["make"] == "DL" and m["taken"].startswith("2026")
    assert exif.photo_meta(jpeg(ref=b"S"), "a")["lat"] < 0
    assert "fix" in exif.photo_meta(jpeg(ref=b""), "a")["problem"] and "placeholder" in exif.photo_meta(jpeg(zero=True), "a")["problem"]
    assert "GPS" in exif.photo_meta(jpeg(gps=False), "a")["problem"] and "Exif" in exif.photo_meta(b"png", "a")["problem"]
    (tmp_path / "a.jpg").write_bytes(jpeg())
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe1\0\x10Exif\0\0II*\0")
    got = exif.read_photos(spark, str(tmp_path)).collect()
    assert sorted(r.name for r in got) == ["a.jpg", "b.jpg"] and sum(r.lat is None for r in got) == 1


def test_sinks(spark, tmp_path):
    p, c = _drawing(spark, "/root/testdata/sf0.001")
    sinks.write_ordered(sinks.to_dxf(p, c), str(tmp_path / "d"), ["part", "layer"])
    text = "".join(f.read_bytes().decode() for f in sorted((tmp_path / "d").glob("part-*")))
    lines = text.split("\r\n")
    assert lines[:2] == ["0", "SECTION"] and lines[-3:-1] == ["0", "EOF"]
    codes = lines[0::2]
    assert all(x.strip().isdigit() for x in codes if x)
    svg = sinks.to_svg(p, c, 100.0, 100.0, "a < b", boundary=False).orderBy("part", "sub")
    import xml.etree.ElementTree as ET

    root = ET.fromstring("\n".join(r.text for r in svg.collect()).encode())
    assert len(root.findall(".//{*}path")) == p.where("size(pts) > 1").count() and len(root.findall(".//{*}circle")) == c.count()
    files = dict(sinks.to_shapefiles(p.limit(20), c, Sheet(Frame(100, 100, 1.0, fixtures.WEST, fixtures.NORTH), 200), "my map", "EPSG:25833"))
    assert set(files) == {f"my-map-{a}.{b}" for a in ("lines", "points") for b in ("shp", "shx", "dbf", "prj")}
    assert sum(1 for _ in vector.table_records(files["my-map-points.dbf"])) == c.count()
    data = vector.stored_zip(list(files.items()))
    assert data == vector.stored_zip(list(files.items())) and zipfile.ZipFile(BytesIO(data)).testzip() is None
