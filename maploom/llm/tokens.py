"""Token-id files: ids of all documents in a row, with Elias-Fano document boundaries."""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maploom.llm.shards import MANIFEST, File, commit, cuts, manifest, places
from maploom.llm.shared import Cut, as_bytes, cut_words, open_fs

MAGIC = b"MLTOKEF1"
#: Text bytes of a shard, bytes at which a file is closed, text bytes tokenised together, words remembered by a worker,
#: and pieces of text after which it begins to remember anew.
SHARD_BYTES, FILE_BYTES, PIECE, REMEMBER, ANEW = 16 << 20, 64 << 20, 4 << 20, 300_000, 64


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A rising sequence of n numbers in about 2 + log2(range / n) bits each.

    The low bits stand side by side; the high bits are a bit row in which number i with high part v sets bit v + i.
    Every 512th set bit has its place recorded, from there select counts words.
    """

    STEP = 512

    def __init__(self, n: int, low_bits: int, first: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray | None = None) -> None:
        self.n, self.low_bits, self.first, self.low, self.high = n, low_bits, first, low, high
        self.samples = np.flatnonzero(self._bits())[:: self.STEP].astype("<u4") if samples is None else samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.empty(0, np.uint8), np.empty(0, "<u8"))
        first = int(values[0])
        v = values.astype(np.uint64) - np.uint64(first & 0xFFFFFFFFFFFFFFFF)
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        high = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(high[-1]) + 1) // 64) * 64, np.uint8)
        bits[high] = 1
        if low_bits:
            part = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(part.ravel(), bitorder="little")
        else:
            low = np.empty(0, np.uint8)
        return cls(n, low_bits, first, low, np.packbits(bits, bitorder="little").view("<u8"))

    def _bits(self) -> np.ndarray:
        return np.unpackbits(self.high.view(np.uint8), bitorder="little")

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        raw = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little")
        return raw >> (at % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Number i, from the nearest recorded place on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        left, at = i % self.STEP, int(self.samples[i // self.STEP])
        word, rest = at // 64, int(self.high[at // 64]) >> (at % 64) << (at % 64)
        while (ones := rest.bit_count()) <= left:
            left, word = left - ones, word + 1
            rest = int(self.high[word])
        for _ in range(left):
            rest &= rest - 1
        place = word * 64 + (rest & -rest).bit_length() - 1
        return self.first + ((place - i) << self.low_bits | self._low(i))

    def part(self, i: int, j: int) -> np.ndarray:
        """Numbers i to j - 1, from the nearest recorded place on: only the words that hold them are looked at."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.empty(0, np.int64)
        first, last = i // self.STEP, -(-j // self.STEP)
        word = int(self.samples[first]) // 64
        end = int(self.samples[last]) // 64 + 1 if last < len(self.samples) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[word:end].view(np.uint8), bitorder="little")) + word * 64
        skip = i - first * self.STEP + int(np.searchsorted(places, self.samples[first]))
        out = (places[skip : skip + j - i] - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at, stop = i * self.low_bits, j * self.low_bits
            bits = np.unpackbits(self.low[at // 8 : -(-stop // 8)], bitorder="little")[at % 8 : at % 8 + stop - at]
            out |= (bits.reshape(j - i, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (out + np.uint64(self.first & 0xFFFFFFFFFFFFFFFF)).astype(np.int64)

    def pack(self) -> bytes:
        head = struct.pack("<QBqQQQ", self.n, self.low_bits, self.first, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> EliasFano:
        n, low_bits, first, a, b, c = struct.unpack_from("<QBqQQQ", data)
        at = struct.calcsize("<QBqQQQ")
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, "<u8", b, at + a)
        return cls(n, low_bits, first, low, high, np.frombuffer(data, "<u4", c, at + a + 8 * b))


# ---------------------------------------------------------------- tokenising


#: The split that a plain word passes whole: letters in one piece, other marks in one piece.
_PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A plain word: ASCII marks, letters up to U+017F, which are composed and have one lower case but for the dotted I, ASCII
#: marks. An apostrophe before letters may take some of them, so there is none.
_PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte in byte-level vocabularies: itself if it prints, else the next free letter from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in prints else chr(next(rest)) for b in range(256)}


def cut_at_blanks(text: bytes, most: int = PIECE):
    """Pieces of about `most` bytes, each but the first beginning with white space."""
    at = 0
    while at < len(text):
        end = at + most
        while end < len(text) and (text[end] not in b" \t\n\v\f\r" or text[end - 1] in b" \t\n\v\f\r"):
            end += 1
        yield text[at:end]
        at = end


class Encoder:
    """Token ids as little-endian numbers, the same as the library gives for the whole text.

    White space separates the tokens of these vocabularies, so words are encoded alone and remembered. A plain word, letters
    with marks around them, needs no normalising but lower case and splits in at most three, so its letters go to the
    library's model at once; other unknown words are encoded in one call, between two special tokens each.
    """

    def __init__(self, path: str, remember: int = REMEMBER) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        plan = json.loads(self.library.to_str())
        parts = plan["pre_tokenizer"] and plan["pre_tokenizer"].get("pretokenizers", [{}])
        split = parts and parts[0]
        if plan["post_processor"] or not split or r"\s" not in str(split.get("pattern")) or split.get("behavior") != "Removed":
            raise ValueError("this tokenizer doesn't drop white space, so words can't be encoded alone")
        special = [t for t in plan["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.mark, self.mark_id = special[-1]["content"], special[-1]["id"]
        self.names = [t["content"].encode() for t in plan["added_tokens"]]
        kinds = [n["type"] for n in (plan["normalizer"] or {}).get("normalizers", [])]
        bytes_ = parts[1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        self.plain = plan["model"]["type"] == "BPE" and kinds == ["NFC", "Replace", "Lowercase"] and split["pattern"] == {"Regex": _PLAIN_SPLIT} and split["invert"] and bytes_
        self.letters = _byte_letters()
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.shortest = min(map(len, self.names), default=1 << 30)
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.pieces, self.remember = 0, remember

    def _around(self, marks: str) -> bytes:
        if (ids := self.marks.get(marks)) is None:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            ids = self.marks[marks] = self._ids(marks).tobytes()
        return ids

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.type)

    def _learned(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that aren't remembered."""
        out: list[bytes | None] = [None] * len(words)
        plain, others, cores = [], [], {}
        known, match = self.known, _PLAIN.fullmatch if self.plain else lambda text: None
        for i, w in enumerate(words):
            if len(w) >= self.shortest and any(x in w for x in self.names):
                out[i] = self._ids(w.decode()).tobytes()
            elif m := match(w.decode()):
                head, core, tail = m.groups()
                core = core.lower()
                plain.append((i, head, core, tail))
                cores[core] = None
            else:
                others.append(i)
        tokenize, room = self.library.model.tokenize, self.remember - len(known)
        for core in cores:
            raw = core.encode()
            if (ids := known.get(raw)) is None:
                text = core if core.isascii() else raw.decode("latin-1").translate(self.letters)
                ids = array(self.code, [t.id for t in tokenize(text)]).tobytes()
                if room > 0:
                    known[raw], room = ids, room - 1
            cores[core] = ids
        for i, head, core, tail in plain:
            out[i] = self._around(head) + cores[core] + self._around(tail) if head or tail else cores[core]
        for at in range(0, len(others), 2000):
            part = others[at : at + 2000]
            ids = self._ids(self.mark.join([words[i].decode() for i in part]))
            cuts_at = np.flatnonzero(ids == self.mark_id)
            if len(cuts_at) != len(part) - 1:
                raise ValueError("the tokenizer lost a separator")
            for n, (i, x) in enumerate(zip(part, np.split(ids, cuts_at), strict=True)):
                out[i] = x.tobytes() if n == 0 else x[1:].tobytes()
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out, part, held = [], [], 0
        for text in texts:
            if len(text) > 2 * PIECE:
                out += self._encode(part)
                part, held = [], 0
                out.append(b"".join(x for p in cut_at_blanks(text) for x in self._encode([p])))
                continue
            part.append(text)
            held += len(text)
            if held > PIECE:
                out += self._encode(part)
                part, held = [], 0
        return out + self._encode(part)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        """Each different word of the texts is looked up once; their ids are then laid out by numpy."""
        cut = cut_words(texts)
        ids, bounds = self._laid_out(cut)
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """How many ids each text has."""
        cut = cut_words(texts)
        each = np.fromiter(map(len, self._looked_up(cut.words)), np.int64, len(cut.words)) // self.type.itemsize
        return np.diff(np.concatenate([[0], np.cumsum(each[cut.index])])[cut.bounds])

    def _looked_up(self, words: list[bytes]) -> list[bytes]:
        """Frequent words come early, so the first to come are remembered, as many as have room; later ones serve this piece alone."""
        self.pieces += 1
        if self.pieces % ANEW == 0:
            self.known = {}
        found = list(map(self.known.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        learned = self._learned([words[i] for i in new])
        room = self.remember - len(self.known)
        for i, ids in zip(new, learned, strict=True):
            found[i] = ids
            if room > 0:
                self.known[words[i]], room = ids, room - 1
        return found

    def _laid_out(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        found = self._looked_up(cut.words)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.type.itemsize
        flat = np.frombuffer(b"".join(found), self.type)
        each = size[cut.index]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat((np.cumsum(size) - size)[cut.index] - ends[:-1], each)
        at += np.arange(ends[-1])
        return flat[at], ends[cut.bounds]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ---------------------------------------------------------------- files


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the token ids of docs (doc_id, text), each with end_id after it, and returns the manifest.

    Documents are in ascending doc_id over all files, null first, repeated ids by a hash of their text; the same rows
    give the same files. A null or empty text has end_id alone. Ids take two bytes each where the vocabulary
    allows. A shard is a range of (doc_id, hash) with about shard_bytes of text, so an id that very many different texts
    share is cut too. Documents travel to their shard as compressed ids, not as text. No documents give an empty manifest.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    at = cuts(rows.select(F.col("doc_id").alias("k"), "h", (F.octet_length("text") + 64).cast("long").alias("w")), shard_bytes)

    width = Encoder(tokenizer).type.itemsize

    def encode(batches):
        tool, pack = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], tool.type).tobytes()
        for batch in batches:
            # A part of a batch at a time, so that ids of long texts don't stand beside all others.
            for i in range(0, len(batch), 2000):
                part = batch.slice(i, 2000)
                ids = pa.array([pack.compress(x + end) for x in tool.encode(as_bytes(part.column(1)))], pa.binary())
                shard = pa.array(places(at, part.column(0), part.column(2)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), ids, shard], ["doc_id", "h", "ids", "shard"])

    packed = rows.select("doc_id", "text", "h").mapInArrow(encode, "doc_id long, h long, ids binary, shard int")
    packed = packed.repartitionById(len(at) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "h", "ids").select("shard", "doc_id", "ids")

    def finish(file, width, names, nulls, ends):
        parts = [EliasFano.of(np.array(names, np.int64)).pack(), EliasFano.of(np.array([0, *ends], np.int64)).pack()]
        for part in parts:
            file.write(part)
        foot = json.dumps({"width": width, "ids": ends[-1], "docs": len(ends), "nulls": nulls, "sizes": [len(p) for p in parts]}).encode()
        file.write(foot + struct.pack("<I", len(foot)) + MAGIC)
        file.records, file.ids = len(ends), ends[-1]
        return file.row()

    def write(batches):
        unpack = zstandard.ZstdDecompressor()
        file, seq = None, 0
        for batch in batches:
            for shard, doc_id, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if file is not None and (file.shard != shard or file.bytes >= file_bytes):
                    seq = seq + 1 if file.shard == shard else 0
                    yield finish(file, width, names, nulls, ends)
                    file = None
                elif file is None:
                    seq = 0
                if file is None:
                    file, names, nulls, ends = File(folder, shard, seq, "tok"), [], 0, []
                    file.write(MAGIC)
                raw = unpack.decompress(ids)
                file.write(raw)
                ends.append((ends[-1] if ends else 0) + len(raw) // width)
                if doc_id is None:
                    nulls += 1
                else:
                    names.append(doc_id)
        if file is not None:
            yield finish(file, width, names, nulls, ends)

    return commit(packed.mapInArrow(write, MANIFEST), folder)


class TokenFile:
    """Random access to one file: docs, doc(i) -> (doc_id, ids)."""

    def __init__(self, uri: str) -> None:
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        n = struct.unpack("<I", tail[:4])[0]
        self.foot = json.loads(self.file.read_at(n, size - 12 - n))
        a, b = self.foot["sizes"]
        at = size - 12 - n - b
        self.bounds = EliasFano.unpack(self.file.read_at(b, at))
        self.names = EliasFano.unpack(self.file.read_at(a, at - a))
        self.type = np.dtype("<u2" if self.foot["width"] == 2 else "<u4")
        self.docs = self.foot["docs"]

    def doc(self, i: int) -> tuple[int | None, np.ndarray]:
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        name = None if i < self.foot["nulls"] else self.names.select(i - self.foot["nulls"])
        w = self.type.itemsize
        return name, np.frombuffer(self.file.read_at((b - a) * w, 8 + a * w), self.type)

    def stretches(self, most: int = 1 << 20, docs: int = 4096):
        """(doc ids, boundaries, ids) of runs of documents, about `most` ids and at most `docs` documents at a time."""
        w, nulls, i = self.type.itemsize, self.foot["nulls"], 0
        while i < self.docs:
            bounds = self.bounds.part(i, min(i + docs, self.docs) + 1)
            n = max(1, int(np.searchsorted(bounds, bounds[0] + most, "right")) - 1)
            bounds, j = bounds[: n + 1], i + n
            names = [None] * max(0, min(j, nulls) - i) + self.names.part(max(0, i - nulls), max(0, j - nulls)).tolist()
            raw = self.file.read_at(int(bounds[-1] - bounds[0]) * w, 8 + int(bounds[0]) * w)
            yield names, bounds, np.frombuffer(raw, self.type)
            i = j


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the files that the manifest names, and its ids on demand.

    start: ids of all documents before it, over all files. ids_crc32: of the ids as little-endian unsigned 32-bit integers.
    """
    # One row a file: the only window without a partition is over the manifest.
    files = manifest(spark, folder)
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    files = files.select("file", before.alias("before"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * ids

    def run(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for docs, bounds, flat in TokenFile(f"{folder}/{path}").stretches():
                    wide = flat.astype("<u4")
                    cut = (bounds - bounds[0]).tolist()
                    parts = [wide[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                    cols = [docs, (bounds[:-1] + before).tolist(), np.diff(bounds).tolist(), [zlib.crc32(p) for p in parts]] + [[p.astype(np.int32) for p in parts]] * ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return files.repartition(max(1, files.count())).mapInArrow(run, schema)
