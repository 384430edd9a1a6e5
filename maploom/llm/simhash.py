"""SimHash near-duplicates by tiled exact comparison.

Two fingerprints within radius r agree in one of r + 1 equal bands of their bits, so the rows with a band's value
are a tile, and a value that one row alone has is none. Within a tile rows stand in order of their population counts,
and blocks whose counts differ by more than r never meet, as each bit that differs moves a count by one.
What is left is compared by numpy exclusive-or and bit counts. A tile too large for one task is cut by
population count, and further by hash; its parts meet the parts within r. A task returns only links that
join two of its groups, so a group of n copies yields n links or so, not n squared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.llm.components import components
from maploom.llm.shared import as_bytes, written

SEED = 42
RADIUS = 2
#: Rows of a tile that one task holds; larger tiles are cut in blocks of about this size.
BLOCK = 8192
#: Bytes of one comparison matrix.
CHUNK = 1 << 20


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; of the whole sequence if it is shorter; empty if there is no word."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, ">u8")
    join, digest = b" ".join, xxhash.xxh64_digest
    if len(words) <= k:
        return np.frombuffer(digest(join(words), SEED), ">u8")
    return np.frombuffer(b"".join([digest(join(s), SEED) for s in zip(*(words[i:] for i in range(k)), strict=False)]), ">u8")


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half the rows of big-endian 64-bit hashes, as one byte row for each hash column."""
    rows = hashes.view(np.uint8).reshape(len(hashes), -1)
    counts = np.zeros(rows.shape[1] * 8, np.int64)
    for at in range(0, len(rows), 1 << 15):
        counts += np.unpackbits(rows[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(rows))


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """The 64-bit fingerprint, signed; 0 if there is no word."""
    h = shingle_hashes(text, k)
    return int(majority(h).view(">i8")[0]) if len(h) else 0


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text); a null text counts as empty, a null doc_id stays."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x, k) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- comparison in tasks


def _population(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


class _Tile:
    """One block of a tile: held rows, in order of their population counts once there are no more, and which of them are linked so far."""

    def __init__(self, limit) -> None:
        self.ids, self.words, self.size = np.empty(0, np.int64), None, np.empty(0, np.float64)
        self.limit, self.joined = limit, False

    def hold(self, ids, words, size) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.words = words if self.words is None else np.concatenate([self.words, words])
        self.size = np.concatenate([self.size, size])

    def _in_order(self) -> np.ndarray:
        """Puts the held rows in order; their places before."""
        self.joined = True
        if self.words is None:
            return np.empty(0, np.int64)
        pops = _population(self.words)
        order = np.argsort(pops, kind="stable")
        self.ids, self.words, self.size, self.pops = self.ids[order], self.words[order], self.size[order], pops[order]
        return order

    def _near(self, words, size) -> Iterator[tuple[int, np.ndarray]]:
        """(row, held rows within reach) for rows with any. Held rows whose population counts are out of a block's reach aren't looked at."""
        step = max(1, CHUNK // (8 * max(1, len(self.ids))))
        pops = _population(words)
        order = np.argsort(pops, kind="stable")
        for at in range(0, len(words), step):
            rows = order[at : at + step]
            limit = np.broadcast_to(self.limit(size[rows, None], self.size[None, :]), (len(rows), len(self.ids)))
            reach = limit.max()
            a = int(np.searchsorted(self.pops, pops[rows[0]] - reach, "left"))
            b = int(np.searchsorted(self.pops, pops[rows[-1]] + reach, "right"))
            if reach < 0 or a >= b:
                continue
            part, held = words[rows], self.words[a:b]
            apart = np.zeros((len(rows), b - a), np.uint16)
            for w in range(words.shape[1]):
                apart += np.bitwise_count(part[:, w, None] ^ held[None, :, w])
            hit = apart <= limit[:, a:b]
            for i in np.flatnonzero(hit.any(axis=1)):
                yield int(rows[i]), a + np.flatnonzero(hit[i])

    def _merge(self, near: np.ndarray) -> np.ndarray:
        """One held row for each group among near; the groups become one."""
        groups, first = np.unique(self.group[near], return_index=True)
        if len(groups) > 1:
            self.group[np.isin(self.group, groups[1:])] = groups[0]
        return near[first]

    def within(self) -> Iterator[tuple[int, int]]:
        """Links among the held rows."""
        self._in_order()
        self.group = np.arange(len(self.ids))
        if len(self.ids) > 1:
            for i, near in self._near(self.words, self.size):
                if len(near) > 1:
                    for j in self._merge(near):
                        if self.ids[i] != self.ids[j]:
                            yield int(self.ids[i]), int(self.ids[j])

    def against(self, ids, words, size) -> Iterator[tuple[int, int]]:
        """Links of rows that pass by."""
        if len(self.ids):
            for i, near in self._near(words, size):
                for j in self._merge(near):
                    if ids[i] != self.ids[j]:
                        yield int(ids[i]), int(self.ids[j])


class _SetTile(_Tile):
    """A tile with the rows' sets: fingerprints choose the pairs to compare, the sets decide which are linked."""

    def __init__(self, limit, similarity: float) -> None:
        super().__init__(limit)
        self.similarity, self.sets = similarity, []

    def hold(self, ids, words, size, sets) -> None:
        super().hold(ids, words, size)
        self.sets += sets

    def _similar(self, codes, n, near) -> np.ndarray:
        """Which held rows among near are similar to a set of n hashes, of which the tile has these codes."""
        if not len(near):
            return np.zeros(0, bool)
        sizes = self.size[near].astype(np.int64)
        self.mark[codes] = True
        both = np.add.reduceat(self.mark[np.concatenate([self.codes[j] for j in near])], np.cumsum(sizes) - sizes, dtype=np.int64)
        self.mark[codes] = False
        return both / (n + sizes - both) >= self.similarity

    def _linked(self, codes, n, near) -> np.ndarray:
        """Similar rows among near, at least one of each group that has any: a group's first row, and the others if that isn't."""
        groups = self.group[near]
        ok, first = np.zeros(len(near), bool), np.unique(groups, return_index=True)[1]
        ok[first] = self._similar(codes, n, near[first])
        rest = ~np.isin(groups, groups[ok])
        rest[first] = False
        ok[rest] = self._similar(codes, n, near[rest])
        return near[ok]

    def within(self) -> Iterator[tuple[int, int]]:
        self.sets = [self.sets[i] for i in self._in_order()]
        self.group = np.arange(len(self.ids))
        if not len(self.ids):
            return
        self.names, codes = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.codes = np.split(codes.astype(np.int32), np.cumsum(self.size.astype(np.int64))[:-1])
        self.mark, self.sets = np.zeros(len(self.names), bool), []
        for i, near in self._near(self.words, self.size):
            near = near[(near < i) & (self.group[near] != self.group[i])]
            if len(near):
                for j in self._merge(np.append(self._linked(self.codes[i], self.size[i], near), i)):
                    if i != j:
                        yield int(self.ids[i]), int(self.ids[j])

    def against(self, ids, words, size, sets) -> Iterator[tuple[int, int]]:
        if len(self.ids):
            for i, near in self._near(words, size):
                at = np.minimum(np.searchsorted(self.names, sets[i]), len(self.names) - 1)
                for j in self._merge(self._linked(at[self.names[at] == sets[i]], size[i], near)):
                    yield int(ids[i]), int(self.ids[j])


class _Marks(_Tile):
    """A tile that only tells which rows have another within reach."""

    def __init__(self, limit) -> None:
        super().__init__(limit)
        self.parts, self.marked = [], None

    def _mark(self) -> None:
        if self.marked is None:
            self.order = self._in_order()
            self.marked = np.zeros(len(self.ids), bool)
            if len(self.ids) > 1:
                for i, near in self._near(self.words, self.size):
                    self.marked[i] = len(near) > 1

    def passing(self, words, size) -> np.ndarray:
        self._mark()
        out = np.zeros(len(words), bool)
        if len(self.ids):
            for i, near in self._near(words, size):
                out[i] = True
                self.marked[near] = True
        return out

    def held(self) -> list[pa.RecordBatch]:
        self._mark()
        cuts = np.cumsum([len(p) for p in self.parts])[:-1]
        marked = np.zeros(len(self.ids), bool)
        marked[self.order] = self.marked
        return [p.filter(pa.array(m)) for p, m in zip(self.parts, np.split(marked, cuts), strict=True) if m.any()]


def _candidates(limit, n_words: int):
    """mapInArrow over the rows of _compare: those rows that have another of their unit within reach."""

    def run(batches):
        unit, tile = None, None
        for batch in batches:
            if not len(batch):
                continue
            units, roles, nodes, words, size, cuts = _columns(batch, n_words)
            out: list[pa.RecordBatch] = []
            for a, b in itertools.pairwise([0, *cuts, len(units)]):
                if units[a] != unit:
                    out += tile.held() if tile is not None else []
                    unit, tile = units[a], _Marks(limit)
                part = batch.slice(a, b - a)
                if roles[a] == 0:
                    tile.hold(nodes[a:b], words[a:b], size[a:b])
                    tile.parts.append(part)
                elif (mask := tile.passing(words[a:b], size[a:b])).any():
                    out.append(part.filter(pa.array(mask)))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if tile is not None and (out := tile.held()):
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def _columns(batch, n_words: int):
    """units, roles, nodes, words, size, and where unit or role change."""
    units, roles, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    words = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(n_words)], axis=1).view(np.uint64)
    size = batch.column(3 + n_words).to_numpy(zero_copy_only=False).astype(np.float64)
    return units, roles, nodes, words, size, (np.flatnonzero((np.diff(units) != 0) | (np.diff(roles) != 0)) + 1).tolist()


def _compare(make, n_words: int):
    """mapInArrow over (unit, role, node, w0.., size, perhaps set) sorted by unit and role: role 0 is held, role 1 passes by."""

    def run(batches):
        unit, tile = None, None
        for batch in batches:
            if not len(batch):
                continue
            units, roles, nodes, words, size, cuts = _columns(batch, n_words)
            out: list[tuple[int, int]] = []
            for a, b in itertools.pairwise([0, *cuts, len(units)]):
                if units[a] != unit:
                    if tile is not None and not tile.joined:
                        out += tile.within()
                    unit, tile = units[a], make()
                part = [nodes[a:b], words[a:b], size[a:b]]
                if batch.num_columns > 4 + n_words:
                    part.append([np.frombuffer(x, np.uint64) for x in batch.column(4 + n_words).slice(a, b - a).to_pylist()])
                if roles[a] == 0:
                    tile.hold(*part)
                else:
                    if not tile.joined:
                        out += tile.within()
                    out += tile.against(*part)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
        if tile is not None and not tile.joined and (out := list(tile.within())):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def _dealt(rows: DataFrame, n_words: int, *more: str) -> DataFrame:
    """The rows of a unit in one task, held ones first."""
    return rows.select("unit", "role", "node", *(f"w{i}" for i in range(n_words)), "size", *more).repartition("unit").sortWithinPartitions("unit", "role")


def _streamed(rows: DataFrame, limit, n_words: int) -> DataFrame:
    """Links (a, b) of the units of rows."""
    return _dealt(rows, n_words).mapInArrow(_compare(lambda: _Tile(limit), n_words), "a long, b long")


# ---------------------------------------------------------------- 64-bit fingerprints, small radius


def _bands(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 bands of 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different fingerprints fp within radius; as many as join their groups, not all pairs."""
    if not 0 <= radius < 64:
        raise ValueError("radius is not between 0 and 63")
    if radius == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    values = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", a).bitwiseAND((1 << n) - 1).alias("value")) for i, (a, n) in enumerate(_bands(radius))]
    rows = fps.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*values)).alias("t")).select("fp", "pop", "t.*")
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    own = written(rows.join(sizes, ["band", "value"]), "tiles")
    unit = lambda pop, salt: F.xxhash64("band", "value", pop, salt)
    whole = own.where(F.col("n") <= block).select(unit(F.lit(-1), F.lit(0)).alias("unit"), F.lit(0).alias("role"), "fp")
    large = own.where(F.col("n") > block)
    parts = large.groupBy("band", "value", F.col("pop").alias("to")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # Each row is held in its own part, and passes the parts with up to radius more bits; the other direction meets there too.
    to = large.withColumn("to", F.explode(F.sequence(F.col("pop"), F.col("pop") + radius))).join(parts, ["band", "value", "to"])
    to = to.withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    held = to.where("to = pop").select(unit(F.col("to"), F.col("salt")).alias("unit"), F.lit(0).alias("role"), "fp")
    # Within a part of several blocks, a row passes the blocks after its own.
    passing = to.select("band", "value", "to", "fp", F.explode(F.expr("filter(sequence(0, blocks - 1), x -> to > pop or x > salt)")).alias("b"))
    passing = passing.select(unit(F.col("to"), F.col("b")).alias("unit"), F.lit(1).alias("role"), "fp")
    every = whole.unionAll(held).unionAll(passing).select("unit", "role", F.col("fp").alias("node"), F.col("fp").alias("w0"), F.lit(0.0).alias("size"))
    return _streamed(every, lambda a, b: radius, 1)


def simhash_components(docs: DataFrame, k: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): near-duplicate groups of docs (doc_id, text).

    fingerprint: 16 hex digits. component_id: the smallest doc_id that links reach, the document
    itself included. Links join fingerprints that differ in radius bits or fewer.
    Null or wordless texts have fingerprint zero and link like any other. Repeated rows each give a row.
    A null doc_id stays null and belongs to its fingerprint's group; the id of a group without any doc_id
    is null. Other columns are not read. No documents give no rows.
    """
    fps = written(fingerprints(docs, k), "fps")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "reps")
    found = components(links(reps, radius))
    named = found.join(reps, found.node == reps.fp).select("fp", "root", "first_id")
    least = named.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = named.join(least, "root").select("fp", "least_id")
    of = written(reps.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")), "of")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(of, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- wide fingerprints, by similarity

BITS = 512
BANDS, ROWS = 8, 3
#: Pairs with a set of at most so many shingles are found by prefixes instead, which misses none.
SMALL = 35
#: Hashes of the sets that one task holds of a tile; bits that tell which texts have a candidate, two MB at any size.
HASHES, FILTER = 1 << 22, 1 << 24
_rng = np.random.default_rng(20240101)
_MIX = _rng.integers(1, 1 << 62, size=BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIN = _rng.integers(1, 1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (h ^ (h >> np.uint64(29))) * by
    return x ^ (x >> np.uint64(32))


def wide(text: bytes | None, k: int, similarity: float = 0.8) -> tuple[int, np.ndarray, np.ndarray, list[int]]:
    """(node, fingerprint words, sorted hashes, tile keys) of the set of k-word shingles.

    Two sets this similar share one of the least hashes of each, as many as the smaller part that they may lack and one more:
    these are keys of sets that may meet one of SMALL hashes. Larger sets have a key for each band.
    """
    h = np.unique(shingle_hashes(text, k).astype(np.uint64))
    if not len(h):
        return 0, np.zeros(BITS // 64, np.int64), h, []
    words = np.concatenate([majority(_mixed(h, m).astype(">u8")).view(">i8") for m in _MIX]).astype(np.int64)
    keys = []
    if similarity * len(h) <= SMALL + 1e-9:
        first = h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]
        keys += [xxhash.xxh64_intdigest(x.tobytes(), BANDS) - (1 << 63) for x in first]
    if len(h) > SMALL:
        least = np.array([_mixed(h, m).min() for m in _MIN], np.uint64).reshape(BANDS, ROWS)
        keys += [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least)]
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63), words, h, keys


def _limit(similarity: float, slack: float):
    """Bits that may differ at this Jaccard similarity of sets of given sizes, with some standard deviations more; all of SMALL sets."""

    def limit(a, b):
        low = np.clip(similarity / (1 + similarity) * (a + b) / np.sqrt(np.maximum(a * b, 1)), 0, 1)
        share = np.arccos(low) / math.pi
        bits = np.where(np.minimum(a, b) <= SMALL, BITS, BITS * share + slack * np.sqrt(BITS * share * (1 - share)))
        return np.where(np.minimum(a, b) < similarity * np.maximum(a, b), -1, bits)

    return limit


def _bit(text: bytes | None) -> int:
    return xxhash.xxh64_intdigest(text or b"", SEED) % FILTER


def _sets(bits: DataFrame, k: int):
    """mapInArrow over (doc_id, text, ..): (node, set) of the texts whose bit is among bits, and of few others."""
    among = np.zeros(FILTER // 64, np.int64)
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("w")).toArrow()
    among[words.column("at").to_numpy()] = words.column("w").to_numpy()

    def run(batches):
        for batch in batches:
            found = []
            for text in as_bytes(batch.column(1)):
                if int(among[(b := _bit(text)) >> 6]) >> (b & 63) & 1:
                    h = np.unique(shingle_hashes(text, k).astype(np.uint64)).tobytes()
                    found.append((xxhash.xxh64_intdigest(h, SEED) - (1 << 63), h))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([h for _, h in found], pa.binary())], ["node", "set"])

    return run


def similar_components(docs: DataFrame, k: int = 5, similarity: float = 0.8, slack: float = 4.0, block: int = BLOCK) -> DataFrame:
    """(doc_id, h, component_id, component_h) where links join documents whose sets of k-word shingles have this Jaccard similarity or more.

    At such a similarity a seventh of the bits may differ, and population counts skip no tile pair. So
    fingerprints have 512 bits, and tiles are the equal values of eight keys of three shingle minima each: a
    pair at 0.8 shares one with probability 0.997. Pairs with a set of SMALL shingles or fewer meet by
    prefixes of their sorted hashes, without fail. Within tiles the comparison is the one above, with a
    limit slack standard deviations wide that follows from both set sizes; the rows that have another within it are compared
    once more with their sets, and these alone decide which are linked. Equal shingle sets always link.
    h, Spark's xxhash64 of the text, tells rows that share an id apart: a component's first row by doc_id, null last,
    and then h gives its component_id and component_h.
    Nulls, repeats and empty texts as in simhash_components. docs is read twice and must give the same texts again.
    """
    n = BITS // 64

    def run(batches):
        for batch in batches:
            rows = [wide(x, k, similarity) for x in as_bytes(batch.column(1))]
            words = np.array([r[1] for r in rows], np.int64).reshape(len(rows), n)
            cols = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), *(pa.array(words[:, i]) for i in range(n)), pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array(map(_bit, as_bytes(batch.column(1))), pa.int64()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "size", *(f"w{i}" for i in range(n)), "keys", "bit", "h"])

    ws = [f"w{i}" for i in range(n)]
    schema = "doc_id long, node long, size long, " + ", ".join(f"{w} long" for w in ws) + ", keys array<long>, bit long, h long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    all_rows = written(texts.mapInArrow(run, schema), "wide")
    reps = written(all_rows.groupBy("node").agg(F.min(first).alias("first"), F.first("size").alias("size"), *(F.first(w).alias(w) for w in ws), F.first("keys").alias("keys"), F.first("bit").alias("bit")), "reps")
    tiles = reps.select("node", "size", *ws, F.explode("keys").alias("key"))
    # Both the rows of a block and their hashes have a bound.
    counts = tiles.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("hashes")).where("n > 1").select("key", F.ceil(F.greatest(F.col("n") / block, F.col("hashes") / HASHES)).cast("int").alias("blocks"))
    own = tiles.join(counts, "key").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    unit = lambda b: F.xxhash64("key", b)
    held = own.select(unit(F.col("salt")).alias("unit"), F.lit(0).alias("role"), "node", *ws, "size")
    passing = own.where("blocks > 1").select("key", "node", *ws, "size", F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x > salt)")).alias("b")).select(unit(F.col("b")).alias("unit"), F.lit(1).alias("role"), "node", *ws, "size")
    limit = _limit(similarity, slack)
    near = _dealt(written(held.unionAll(passing), "tiles"), n)
    near = written(near.mapInArrow(_candidates(limit, n), near.schema), "near")
    # Only rows with a candidate travel with their sets; a set goes to each of their tiles.
    bits = near.select("node").distinct().join(reps.select("node", "bit"), "node").select("bit")
    sets = texts.mapInArrow(_sets(bits, k), "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))
    found = components(_dealt(near.join(sets, "node"), n, "set").mapInArrow(_compare(lambda: _SetTile(limit, similarity), n), "a long, b long"))
    named = found.join(reps.select("node", "first"), "node")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(least, "root").select("node", "least")
    of = written(reps.select("node", "first").join(named, "node", "left").select("node", F.coalesce("least", "first").alias("of")), "of")
    return all_rows.select("doc_id", "h", "node").join(of, "node").select("doc_id", "h", F.col("of.doc_id").alias("component_id"), F.col("of.h").alias("component_h"))
