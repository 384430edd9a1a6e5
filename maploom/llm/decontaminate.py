"""Benchmark decontamination by one Aho-Corasick automaton over the normalised windows of all items."""

from __future__ import annotations

import hashlib
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.llm.shared import as_bytes

WINDOW = 10
#: Bytes of item texts that are sent to every task; a benchmark is small by nature, and one beyond this is refused.
MOST_BYTES = 64 << 20
#: Lower-cases A-Z, keeps a-z, 0-9 and every byte of other characters, blanks the rest.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Matcher:
    """Finds the windows of items (item_id, text) in texts."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW) -> None:
        found: dict[bytes, set] = {}
        lengths: dict[bytes, int] = {}
        for item, text in items:
            words = normal_words(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                part = words[i : i + window]
                key = b" " + b" ".join(part) + b" "
                found.setdefault(key, set()).add(item)
                lengths[key] = len(part)
        self.automaton = None
        if found:
            self.automaton = ahocorasick.Automaton()
            for key, of in found.items():
                self.automaton.add_word(key.decode("latin-1"), (lengths[key], len(key), frozenset(of)))
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray, set]:
        """(words, word indexes that lie in an occurrence, items with occurring windows) in one pass over the text."""
        words = normal_words(text)
        if not words or self.automaton is None:
            return len(words), np.empty(0, np.int64), set()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        hits = list(self.automaton.iter(line))
        if not hits:
            return len(words), np.empty(0, np.int64), set()
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        mark, items = np.zeros(len(words) + 1, np.int64), set()
        starts = np.searchsorted(blanks, [end - size + 1 for end, (_, size, _) in hits])
        for first, (_, (n, _, of)) in zip(starts.tolist(), hits, strict=True):
            mark[first] += 1
            mark[first + n] -= 1
            items |= of
        return len(words), np.flatnonzero(np.cumsum(mark[:-1]) > 0), items

    def spans(self, raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
        """Code point spans of the original text that cover the words hit, merged where only non-words lie between."""
        if not len(hit):
            return []
        word = np.frombuffer(b" " + raw.translate(_TABLE) + b" ", np.uint8) != 32
        bounds = np.flatnonzero(word[1:] != word[:-1])
        # Code points before each byte.
        points = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])
        last = np.append(np.flatnonzero(np.diff(hit) > 1), len(hit) - 1)
        first = np.append(0, last[:-1] + 1)
        return list(zip(points[bounds[2 * hit[first]]].tolist(), points[bounds[2 * hit[last] + 1]].tolist(), strict=True))


_built: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[object, bytes]], window: int) -> Matcher:
    """The worker's matcher for these items, built once for all its tasks."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items, window)
    return _built[key]


def matcher_items(items: DataFrame) -> list[tuple[object, bytes]]:
    """The items (item_id, text), refused beyond MOST_BYTES."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the items hold {size} bytes; {MOST_BYTES} can be sent to every task")
    return [(r[0], (r[1] or "").encode()) for r in items.select("item_id", "text").collect()]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for each row of docs (doc_id, text).

    A window is `window` consecutive words of an item (item_id, text), or all words of a shorter one; words are
    counted as hit inside any occurrence. n_items counts different item ids, a null id not among them; items_sha256
    is the digest of those ids, sorted as strings and joined by commas, of the empty string if there are none.
    spans: the covered [start, end) code points of the original text.
    Null or wordless texts have no words and no hits; repeated rows each give a row; empty tables give no rows or no hits.
    """
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, matcher_items(items), window))

    def run(batches):
        matcher = _matcher(*sent.value)
        for batch in batches:
            out = []
            for raw in as_bytes(batch.column(1)):
                n, hit, of = matcher.scan(raw)
                names = sorted(str(x) for x in of if x is not None)
                spans = [{"start": a, "end": b} for a, b in matcher.spans(raw, hit)] if len(hit) else []
                out.append((n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0, spans))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names_)

    names_ = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs (text, ...) without any hit, all columns kept; null and empty texts stay."""
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, matcher_items(items), window))
    at = docs.columns.index("text")

    def run(batches):
        matcher = _matcher(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array([not len(matcher.scan(raw)[1]) for raw in as_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
