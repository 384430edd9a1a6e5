"""Secret scans: keyword prefilter, anchored patterns only near hits, then checksums."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import string
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.llm.shared import as_bytes

KINDS = ("assign", "access", "hex", "crc_token", "jwt")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_CRC = re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_JWT_RUN = re.compile(rb"[A-Za-z0-9_-]+")
_WORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access"}
_WORDS |= {f"gh{x}_": "crc_token" for x in "pousr"} | {"npm_": "crc_token", "eyj": "jwt"}
_BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
#: Letters 0-9a-f become 1, all else 0: a run of 24 is then a keyword of its own.
_HEX = bytes(49 if 48 <= b <= 57 or 97 <= b <= 102 else 48 for b in range(256))
_HEX_LEAST = 24


def base62(n: int, width: int = 6) -> str:
    out = ""
    for _ in range(width):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def _crc_ok(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the body before them, in base 62."""
    return base62(zlib.crc32(m[1])) == m[2].decode()


def _jwt_ok(m: re.Match) -> bool:
    """The first two parts are JSON objects in URL-safe base 64, the header with an algorithm."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(x + b"=" * (-len(x) % 4))) for x in m[0].split(b".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head and isinstance(body, dict)


#: pattern, and whether its match is a finding
_RULES = {"assign": (_ASSIGN, lambda m: len(m[2]) >= 6), "access": (_ACCESS, lambda m: len(m[0]) >= 20), "crc_token": (_CRC, _crc_ok), "jwt": (_JWT, _jwt_ok)}


class Scanner:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for word, kind in _WORDS.items():
            self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then kind as listed. Each kind is leftmost and
        non-overlapping; a match that fails its check is dropped but has used its characters up."""
        found = []
        # latin-1 keeps one character a byte, so offsets are those of the bytes.
        hits = [(end - n + 1, kind) for end, (kind, n) in self.automaton.iter(text.lower().decode("latin-1"))]
        if hits:
            free = dict.fromkeys(KINDS, 0)
            for start, kind in sorted(hits):
                if start < free[kind]:
                    continue
                if m := _RULES[kind][0].match(text, start):
                    free[kind] = m.end()
                    if _RULES[kind][1](m):
                        found.append((start, m.end(), kind))
                elif kind == "jwt":
                    # What follows the run made it fail, and will for every later start in the run.
                    free[kind] = _JWT_RUN.match(text, start).end()
        ones = text.translate(_HEX)
        at = ones.find(b"1" * _HEX_LEAST)
        while at >= 0:
            end = ones.find(b"0", at)
            end = len(ones) if end < 0 else end
            found.append((at, end, "hex"))
            at = ones.find(b"1" * _HEX_LEAST, end)
        found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
        if found and not text.isascii():
            at, n, points = 0, 0, {}
            for byte in sorted({x for s in found for x in s[:2]}):
                n += len(text[at:byte].decode())
                at, points[byte] = byte, n
            found = [(points[a], points[b], kind) for a, b, kind in found]
        return [(kind, a, b) for a, b, kind in found]


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs (doc_id, text).

    spans: kind:start:end of all findings, in code points with the end exclusive, comma-joined by start and
    then kind; base_sha256: the digest of the same text for the kinds assign, access and hex alone. Added kinds:
    crc_token, tokens that carry their own CRC-32, and jwt, whose parts must decode.
    Null and empty texts have no findings; repeated rows each give a row; no documents give no rows.
    """

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            out = []
            for raw in as_bytes(batch.column(1)):
                spans = scanner.scan(raw or b"")
                tell = lambda some: ",".join(f"{k}:{a}:{b}" for k, a, b in some)
                base = [s for s in spans if s[0] in KINDS[:3]]
                out.append((*(sum(s[0] == k for s in base) for k in KINDS[:3]), hashlib.sha256(tell(base).encode()).hexdigest(), tell(spans)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
