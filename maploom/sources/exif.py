"""Photographs' own records: where, when, which way."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession

from maploom.sources.files import binary, parsed

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
META = "name string, lat double, lon double, alt double, direction double, dir_ref string, taken string, make string, model string, orientation int, problem string"


#: JPEG markers without a length, and those at which the headers end.
_ALONE, _LAST = {0x01, *range(0xD0, 0xD9)}, {0xD9, 0xDA}


def exif_start(data: bytes) -> int | None:
    """Where the TIFF part of a JPEG's Exif block begins."""
    at = 2 if data.startswith(b"\xff\xd8") else len(data)
    while (at := data.find(b"\xff", at)) >= 0 and at + 4 <= len(data):
        kind = data[at + 1]
        if kind in _LAST:
            break
        if kind == 0xE1 and data.startswith(b"Exif", at + 4):
            return at + 10
        at += 2 if kind in _ALONE else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def photo_meta(data: bytes, name: str) -> dict:
    """What is known of one photograph; problem says why it has no place."""
    out: dict = {"name": name}
    t = exif_start(data)
    if t is None:
        return out | {"problem": "no Exif block"}
    order = {b"II": "<", b"MM": ">"}.get(data[t : t + 2])
    if order is None:
        return out | {"problem": "damaged Exif header"}

    def tags(at: int) -> dict[int, tuple[int, int, int]]:
        found = {}
        if at + 2 > len(data):
            return found
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            e = at + 2 + 12 * i
            if e + 12 > len(data):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", data, e)
            if kind in _SIZE:
                found[tag] = (kind, n, e + 8 if _SIZE[kind] * n <= 4 else t + struct.unpack_from(order + "I", data, e + 8)[0])
        return found

    def values(entry) -> list:
        if not entry:
            return []
        kind, n, at = entry
        n = max(0, min(n, (len(data) - at) // _SIZE[kind]))
        if kind in (5, 10):
            v = struct.unpack_from(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", data, at)
            return [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)]
        code = {3: "H", 4: "I", 9: "i"}.get(kind, "B")
        return list(struct.unpack_from(f"{order}{n}{code}", data, at))

    text = lambda entry: bytes(v & 255 for v in values(entry)).split(b"\0")[0].decode("latin-1").strip()
    first = tags(t + struct.unpack_from(order + "I", data, t + 4)[0])
    out |= {"make": text(first.get(0x10F)) or None, "model": text(first.get(0x110)) or None}
    if v := values(first.get(0x112)):
        out["orientation"] = int(v[0])
    if v := values(first.get(0x8769)):
        own = tags(t + int(v[0]))
        out["taken"] = text(own.get(0x9003)) or text(own.get(0x9004)) or None
    out["taken"] = out.get("taken") or text(first.get(0x132)) or None
    if not (v := values(first.get(0x8825))):
        return out | {"problem": "no GPS block"}
    gps = tags(t + int(v[0]))

    def degrees(entry, ref):
        v, r = values(gps.get(entry)), text(gps.get(ref))
        return None if len(v) < 3 or r not in tuple("NSEW") else (v[0] + v[1] / 60 + v[2] / 3600) * (-1 if r in "SW" else 1)

    lat, lon = degrees(2, 1), degrees(4, 3)
    if lat is None or lon is None:
        return out | {"problem": "GPS block without a fix"}
    if abs(lat) < 1e-9 and abs(lon) < 1e-9:
        return out | {"problem": "the position reads 0, 0: a placeholder, not a fix"}
    out |= {"lat": lat, "lon": lon}
    if v := values(gps.get(6)):
        out["alt"] = -v[0] if (values(gps.get(5)) or [0])[0] == 1 else v[0]
    if v := values(gps.get(17)):
        out |= {"direction": v[0] % 360, "dir_ref": "M" if text(gps.get(16)) == "M" else "T"}
    if not out["taken"] and (day := text(gps.get(29))):
        out["taken"] = day.replace(":", "-")
    return out


def read_photos(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and the columns of META, a row a file; files that can't be read have a problem."""
    names = [x.split()[0] for x in META.split(", ")]

    def parse(data: bytes, name: str):
        try:
            m = photo_meta(data, name)
        except struct.error as e:
            m = {"name": name, "problem": f"unreadable: {e}"}
        yield tuple(m.get(n) for n in names)

    return parsed(binary(spark, path), parse, META)
