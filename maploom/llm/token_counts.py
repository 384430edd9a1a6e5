"""How many ids public tokenizers give for whole texts."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.llm.shared import as_bytes, cut_words
from maploom.llm.tokens import PIECE, REMEMBER, cut_at_blanks, encoder

#: White space beyond ASCII, in UTF-8: a run of white space may then lie on both sides of a cut.
_OTHER_BLANKS = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class RankedCounter:
    """Counts of a rank file's byte-level vocabulary.

    Its split takes white space together with the word behind it, so a text may be cut wherever white space begins. The
    pieces that come first are remembered with their counts; a text's others are encoded together.
    """

    def __init__(self, path: str, remember: int = REMEMBER) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, int] = {}
        self.remember = remember

    def _count(self, text: bytes) -> int:
        return len(self.library.encode_ordinary(text.decode()))

    def counts(self, texts: list[bytes]) -> np.ndarray:
        odd = [i for i, t in enumerate(texts) if not t.isascii() and _OTHER_BLANKS.search(t)]
        plain = list(texts)
        for i in odd:
            plain[i] = b""
        cut = cut_words(plain, blanks=True)
        found = list(map(self.known.get, cut.words))
        room = self.remember - len(self.known)
        if room > 0:
            for i in [i for i, x in enumerate(found) if x is None][:room]:
                found[i] = self.known[cut.words[i]] = self._count(cut.words[i])
        each = np.array([-1 if x is None else x for x in found], np.int64)[cut.index]
        out = np.diff(np.concatenate([[0], np.cumsum(np.maximum(each, 0))])[cut.bounds])
        unknown = np.flatnonzero(each < 0)
        owner = np.searchsorted(cut.bounds, unknown, "right") - 1
        for i, at in zip(*_runs(owner, unknown), strict=True):
            out[i] += self._count(b"".join([cut.words[x] for x in cut.index[at]]))
        for i in odd:
            out[i] = self._count(texts[i])
        return out


def _runs(owner: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The owners in order, and each one's values."""
    if not len(owner):
        return [], []
    names, first = np.unique(owner, return_index=True)
    return names.tolist(), np.split(values, first[1:])


@lru_cache(maxsize=4)
def counter(path: str):
    """Something with counts(texts) for a tokenizer file."""
    return RankedCounter(path) if path.endswith(".tiktoken") else encoder(path)


def _groups(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[list[int], list[bytes]]]:
    """(rows, pieces) of about `most` bytes together; longer texts are cut where white space begins, unless it may lie across."""
    rows, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        whole = len(text) <= 2 * most or _OTHER_BLANKS.search(text)
        for piece in [text] if whole else cut_at_blanks(text, most):
            rows.append(i)
            pieces.append(piece)
            held += len(piece)
            if held > most:
                yield rows, pieces
                rows, pieces, held = [], [], 0
    if rows:
        yield rows, pieces


def count_ids(texts: list[bytes], path: str) -> np.ndarray:
    """The number of ids of each text."""
    out = np.zeros(len(texts), np.int64)
    for rows, pieces in _groups(texts):
        np.add.at(out, rows, counter(path).counts(pieces))
    return out


def token_counts(docs: DataFrame, tokenizers: dict[str, str], dropped: bytes = b"") -> DataFrame:
    """(doc_id, source, lang, tokens, bare) for each row of docs (doc_id, text, lang, source).

    tokens: the ids of the whole text by each of tokenizers (version: file), in their order; bare: of the text
    without the ASCII characters `dropped`. Nulls and empty texts have no ids; other columns are not read.
    """
    paths = list(tokenizers.values())

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                texts = [t or b"" for t in as_bytes(part.column(3))]
                tokens = np.array([count_ids(texts, p) for p in paths]).reshape(len(paths), -1).T
                bare, fewer = tokens.copy(), [t.translate(None, dropped) for t in texts]
                # Only texts that lose something are counted again.
                rows = [i for i, (a, b) in enumerate(zip(texts, fewer, strict=True)) if len(a) != len(b)]
                if rows:
                    bare[rows] = np.array([count_ids([fewer[i] for i in rows], p) for p in paths]).reshape(len(paths), -1).T
                lists = [pa.array(x.tolist(), pa.list_(pa.int64())) for x in (tokens, bare)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], ["doc_id", "source", "lang", "tokens", "bare"])

    text = lambda c: F.col(c).cast("string").alias(c)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text("source"), text("lang"), text("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokens array<long>, bare array<long>")
