"""Coordinate frames: cells, map units, grid units, sheet millimetres, and UTM."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int


def _c(v: Value) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


@dataclass(frozen=True)
class Frame:
    """A raster's place: rows count down from the north, columns to the east, values sit at cell centres."""

    nrows: int
    ncols: int
    cell: float = 1.0
    origin_x: float = 0.0
    origin_y: float | None = None
    crs: str | None = None

    def __post_init__(self):
        if self.origin_y is None:
            object.__setattr__(self, "origin_y", self.nrows * self.cell)

    @property
    def width(self) -> float:
        return self.ncols * self.cell

    @property
    def height(self) -> float:
        return self.nrows * self.cell

    @property
    def south(self) -> float:
        return self.origin_y - self.height

    @property
    def east(self) -> float:
        return self.origin_x + self.width

    def easting(self, c: Column) -> Column:
        return F.lit(self.origin_x) + (c + 0.5) * self.cell

    def northing(self, r: Column) -> Column:
        return F.lit(self.origin_y) - (r + 0.5) * self.cell

    def to_grid(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (x - self.origin_x) / self.cell, (F.lit(self.origin_y) - y) / self.cell

    def to_map(self, gx: Column, gy: Column) -> tuple[Column, Column]:
        return F.lit(self.origin_x) + gx * self.cell, F.lit(self.origin_y) - gy * self.cell

    def inside(self, gx: Column, gy: Column) -> Column:
        return gx.between(0, self.ncols) & gy.between(0, self.nrows)


#: Scales that a sheet is offered at, finest first.
SCALES = (20, 50, 100, 200, 250, 500, 1000, 2000, 2500, 5000, 10000)


def stretched(frame: Frame, width: int, height: int) -> Frame:
    """The frame of an image without a place of its own: laid over a raster from its north-west corner, as wide as that is."""
    return Frame(height, width, frame.width / width, frame.origin_x, frame.origin_y, frame.crs)


@dataclass(frozen=True)
class Sheet:
    """Map units to millimetres on a sheet, y upwards."""

    frame: Frame
    scale: float = 200
    margin: float = 0.0
    units_per_metre: float = 1.0

    @property
    def mm_per_unit(self) -> float:
        return 1000 / self.scale / self.units_per_metre

    @property
    def width(self) -> float:
        return self.frame.width * self.mm_per_unit + 2 * self.margin

    @property
    def height(self) -> float:
        return self.frame.height * self.mm_per_unit + 2 * self.margin

    def x(self, x: Value) -> Column:
        return self.margin + (_c(x) - self.frame.origin_x) * self.mm_per_unit

    def y(self, y: Value) -> Column:
        return self.margin + (_c(y) - self.frame.south) * self.mm_per_unit

    def inv_x(self, x: Value) -> Column:
        return self.frame.origin_x + (_c(x) - self.margin) / self.mm_per_unit

    def inv_y(self, y: Value) -> Column:
        return self.frame.south + (_c(y) - self.margin) / self.mm_per_unit

    def length(self, d: Value) -> Column:
        return _c(d) * self.mm_per_unit

    def inv_length(self, mm: Value) -> Column:
        return _c(mm) / self.mm_per_unit

    def holds(self, x: Column, y: Column) -> Column:
        return x.between(0, self.width) & y.between(0, self.height)

    def doubt_mm(self, metres: float = 7) -> float:
        """A position's doubt on the ground, on the sheet."""
        return metres * self.mm_per_unit


def fit_scale(frame: Frame, bed_w: float, bed_h: float, margin: float = 0, units_per_metre: float = 1) -> int | None:
    """The first scale of SCALES at which the sheet fits the bed."""
    for s in SCALES:
        sheet = Sheet(frame, s, margin, units_per_metre)
        if sheet.width <= bed_w and sheet.height <= bed_h:
            return s
    return None


# The GRS 80 ellipsoid and the UTM scale factor.
_A, _F, _K0 = 6378137.0, 1 / 298.257222101, 0.9996
_E2 = _F * (2 - _F)
_EP2 = _E2 / (1 - _E2)


def utm_zone(lon: Column) -> Column:
    return (F.floor(F.pmod(lon + 180, F.lit(360.0)) / 6) + 1).cast("int")


def zone_of_epsg(crs: Column) -> tuple[Column, Column]:
    """(zone, south) of EPSG codes 25828-25838, 32601-32660 and 32701-32760; null for others."""
    code = F.nullif(F.regexp_extract(F.trim(crs), "(?i)^EPSG:([0-9]+)$", 1), F.lit("")).try_cast("int")
    north = F.when(code.between(25828, 25838), code - 25800).when(code.between(32601, 32660), code - 32600)
    south = code.between(32701, 32760)
    zone = F.when(south, code - 32700).otherwise(north)
    return zone, F.when(zone.isNotNull(), south)


def _arc(p: Column) -> Column:
    """Meridian arc length from the equator."""
    e2, e4, e6 = _E2, _E2**2, _E2**3
    terms = ((1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256), -(3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024), (15 * e4 / 256 + 45 * e6 / 1024), -35 * e6 / 3072)
    return _A * (terms[0] * p + terms[1] * F.sin(2 * p) + terms[2] * F.sin(4 * p) + terms[3] * F.sin(6 * p))


def to_utm(lat: Column, lon: Column, zone: Value, south: Value = False) -> tuple[Column, Column]:
    """(easting, northing) of degrees; null where lat, lon or zone is."""
    zone, south = _c(zone), _c(south)
    p = lat * (math.pi / 180)
    dl = (F.pmod(lon - (zone * 6 - 183) + 540, F.lit(360.0)) - 180) * (math.pi / 180)
    sin, cos, tan = F.sin(p), F.cos(p), F.tan(p)
    n = _A / F.sqrt(1 - _E2 * sin * sin)
    t, c, a = tan * tan, _EP2 * cos * cos, cos * dl
    a2 = a * a
    x = _K0 * n * a * (1 + a2 * ((1 - t + c) / 6 + a2 * (5 - 18 * t + t * t + 72 * c - 58 * _EP2) / 120)) + 500000
    y = _K0 * (_arc(p) + n * tan * a2 * (0.5 + a2 * ((5 - t + 9 * c + 4 * c * c) / 24 + a2 * (61 - 58 * t + t * t + 600 * c - 330 * _EP2) / 720)))
    return x, y + F.when(south, 10000000.0).otherwise(0.0)


def from_utm(x: Column, y: Column, zone: Value, south: Value = False) -> tuple[Column, Column]:
    """(lat, lon) in degrees."""
    zone, south = _c(zone), _c(south)
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    arc = (y - F.when(south, 10000000.0).otherwise(0.0)) / _K0
    mu = arc / (_A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
    sin, cos, tan = F.sin(p), F.cos(p), F.tan(p)
    c, t = _EP2 * cos * cos, tan * tan
    w = 1 - _E2 * sin * sin
    n, r = _A / F.sqrt(w), _A * (1 - _E2) / F.pow(w, F.lit(1.5))
    d = (x - 500000) / (n * _K0)
    d2 = d * d
    lat = p - n * tan / r * d2 * (0.5 - d2 * ((5 + 3 * t + 10 * c - 4 * c * c - 9 * _EP2) / 24 - d2 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * _EP2 - 3 * c * c) / 720))
    lon = d * (1 - d2 * ((1 + 2 * t + c) / 6 - d2 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * _EP2 + 24 * t * t) / 120)) / cos
    return lat * (180 / math.pi), (zone * 6 - 183) + lon * (180 / math.pi)
