"""Quality rules: repetition and symbol counts, then divergence from language references."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maploom.llm.shared import Cut, as_bytes, cut_words, written

SYMBOLS = b"#*$%&|<>"
REPEAT, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Documents of fewer words are not held against the reference. Common words of a language: so many of its most frequent.
JS_LEAST_WORDS, COMMON = 50, 64
#: A distance is too far if it exceeds the median of its language and length by so many times the spread between the median and
#: the third quartile, and by this much at least. Where fewer documents share both, those of its length decide, or else all.
SPREADS, LEAST_EXCESS, LEAST_GROUP = 6.0, 0.15, 100
#: Steps of a distance when quartiles are counted; languages whose references are sent to every task, a few kB each.
STEPS, MOST_LANGS = 1000, 4096
#: Words that a task counts before it hands the counts on.
FLUSH = 200_000
CLASSES = ("lower-case Latin", "upper-case Latin", "other letters with case", "letters without case", "marks", "numbers", "blanks", "line ends", "punctuation", "symbols", "others")
_SPACE = np.array([b in b" \t\n\v\f\r" for b in range(256)])
_LATER = np.array([b & 0xC0 == 0x80 for b in range(256)])
_SYMBOL = np.array([b in SYMBOLS for b in range(256)])
_STRIP = ".,;:!?'\"()-"


def class_of(c: str) -> int:
    """The place of a character's class in CLASSES."""
    kind, latin = unicodedata.category(c), c < "ɐ" or "Ḁ" <= c <= "ỿ"
    if c in "\n\r" or kind in ("Zl", "Zp"):
        return 7
    if c == "\t" or kind == "Zs":
        return 6
    if kind in ("Ll", "Lu", "Lt"):
        return 2 if not latin else 0 if kind == "Ll" else 1
    if kind in ("Lo", "Lm"):
        return 3
    return {"M": 4, "N": 5, "P": 8, "S": 9}.get(kind[0], 10)


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    return np.array([class_of(chr(c)) for c in range(0x110000)], np.uint8)


def class_counts(text: bytes, counts: np.ndarray) -> np.ndarray:
    """Characters of each class in a text, of which counts has each byte's number."""
    table = _class_table()
    out = np.bincount(table[:128], weights=counts[:128], minlength=len(CLASSES))
    if counts[128:].any():
        points = np.frombuffer(text.decode().encode("utf-32-le", "surrogatepass"), np.uint32)
        out += np.bincount(table[points[points > 127]], minlength=len(CLASSES))
    return out.astype(np.int64)


def repeated_words(words: np.ndarray, n: int = REPEAT) -> int:
    """Words, given by number, that lie in an n-word window found twice or more, the first occurrence included."""
    if len(words) <= n:
        return 0
    # Equal windows have equal sums, so different sums settle most texts.
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    size = len(words) - n + 1
    sums = np.zeros(size, np.uint64)
    for i in range(n):
        sums = sums * np.uint64(0xBF58476D1CE4E5B9) + mixed[i : i + size]
    order = np.sort(sums)
    if not (order[1:] == order[:-1]).any():
        return 0
    windows = list(zip(*(words[i : i + size].tolist() for i in range(n)), strict=True))
    often = Counter(windows)
    mark = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.fromiter((often[w] > 1 for w in windows), bool, size))
    np.add.at(mark, at, 1)
    np.add.at(mark, at + n, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def measures(texts: list[bytes | None]) -> tuple[Cut, list[tuple[int, int, int, int, int]], list[np.ndarray]]:
    """The texts' words; (words, word_chars, symbols, dup lines, repeated words) and character classes of each text."""
    texts = [t or b"" for t in texts]
    cut = cut_words(texts)
    base, classes = [], []
    for text, a, b in zip(texts, cut.bounds[:-1].tolist(), cut.bounds[1:].tolist(), strict=True):
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        word_chars = int(counts[~_SPACE & ~_LATER].sum())
        lines = [x for x in text.split(b"\n") if x.strip()]
        base.append((b - a, word_chars, int(counts[_SYMBOL].sum()), len(lines) - len(set(lines)), repeated_words(cut.index[a:b])))
        classes.append(class_counts(text, counts))
    return cut, base, classes


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, 0 to 1; 0 if both are empty, 1 if one is."""
    a, b = np.asarray(p, float), np.asarray(q, float)
    if not a.sum() or not b.sum():
        return float(bool(a.sum()) != bool(b.sum()))
    a, b = a / a.sum(), b / b.sum()
    m = (a + b) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return math.sqrt(min(1.0, max(0.0, (part(a) + part(b)) / 2)))


def _plain_words(cut: Cut) -> tuple[list[str], np.ndarray]:
    """Lower-case words without marks around them, and each word's place among them."""
    names: dict[str, int] = {}
    at = np.fromiter((names.setdefault(w.decode().strip(_STRIP).lower(), len(names)) for w in cut.words), np.int64, len(cut.words))
    return list(names), at


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def _parts(batches):
    """Batches in parts of bounded size."""
    for batch in batches:
        for at in range(0, len(batch), 1000):
            yield batch.slice(at, 1000)


def references(docs: DataFrame, least_words: int = JS_LEAST_WORDS, common: int = COMMON) -> DataFrame:
    """(lang, item, n): the class counts of each language, items 0, 1, .. by class, and its `common` most frequent words with
    theirs, over all documents of docs (doc_id, lang, text) that have least_words words and didn't fail. Of words
    equally frequent the first by code point is more common. Languages without such documents have no rows."""

    def run(batches):
        words: dict[str | None, Counter] = {}
        sums: dict[str | None, np.ndarray] = {}

        def flushed():
            out = [(lang, str(i), True, int(n)) for lang, c in sums.items() for i, n in enumerate(c)]
            out += [(lang, w, False, n) for lang, c in words.items() for w, n in c.items()]
            words.clear(), sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 4, [pa.string(), pa.string(), pa.bool_(), pa.int64()], strict=True)], ["lang", "item", "class", "n"])

        for part in _parts(batches):
            cut, base, classes = measures(as_bytes(part.column(2)))
            names, at = _plain_words(cut)
            plain = at[cut.index]
            good: dict[str | None, list[int]] = {}
            for i, lang in enumerate(part.column(1).to_pylist()):
                if base[i][0] >= least_words and not base_failed(base[i][0], base[i][4]):
                    good.setdefault(lang, []).append(i)
            for lang, rows in good.items():
                sums[lang] = sums.get(lang, 0) + sum(classes[i] for i in rows)
                n = np.bincount(np.concatenate([plain[cut.bounds[i] : cut.bounds[i + 1]] for i in rows]), minlength=len(names))
                words.setdefault(lang, Counter()).update({names[i]: int(n[i]) for i in np.flatnonzero(n).tolist() if names[i]})
            if sum(map(len, words.values())) > FLUSH:
                yield flushed()
        if sums:
            yield flushed()

    # Sums are built in each task first: no row of a language waits for another.
    rows = _texts(docs).mapInArrow(run, "lang string, item string, class boolean, n long").groupBy("lang", "class", "item").agg(F.sum("n").alias("n"))
    rows = written(rows, "sums")
    # Each task hands on its own most frequent words only: a filter right above the window is a limit below the shuffle too.
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "item"))
    frequent = rows.where(~F.col("class")).withColumn("at", first).where(F.col("at") <= common)
    return frequent.drop("at").unionByName(rows.where("class")).select("lang", "item", "class", "n")


def distances(docs: DataFrame, refs: DataFrame, least_words: int = JS_LEAST_WORDS) -> DataFrame:
    """The base measures of each row of docs, and its distances to its language's reference, null where there is none to hold
    it against."""
    by: dict[str | None, tuple[np.ndarray, dict[str, int]]] = {}
    if refs.select("lang").distinct().count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    # CLASSES and COMMON rows a language at most.
    for r in refs.collect():
        classes, words = by.setdefault(r["lang"], (np.zeros(len(CLASSES), np.int64), {}))
        if r["class"]:
            classes[int(r["item"])] = r["n"]
        else:
            words[r["item"]] = r["n"]
    sent = docs.sparkSession.sparkContext.broadcast(by)
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 2

    def run(batches):
        refs = {lang: (classes, sorted(words), np.array([words[w] for w in sorted(words)], np.int64)) for lang, (classes, words) in sent.value.items()}
        for part in _parts(batches):
            cut, base, classes = measures(as_bytes(part.column(2)))
            places, at = _plain_words(cut)
            where, plain = {w: i for i, w in enumerate(places)}, at[cut.index]
            number: dict[str | None, np.ndarray] = {}
            out = []
            for i, lang in enumerate(part.column(1).to_pylist()):
                failed, far = base_failed(base[i][0], base[i][4]), (None, None)
                if lang in refs and not failed and base[i][0] >= least_words:
                    class_sums, common, word_sums = refs[lang]
                    if lang not in number:
                        number[lang] = np.full(len(places) + 1, -1)
                        number[lang][[where.get(w, len(places)) for w in common]] = np.arange(len(common))
                        number[lang][-1] = -1
                    found = number[lang][plain[cut.bounds[i] : cut.bounds[i + 1]]]
                    far = js_distance(classes[i], class_sums), js_distance(np.bincount(found[found >= 0], minlength=len(common)), word_sums)
                out.append((*base[i], failed, *far))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return _texts(docs).mapInArrow(run, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double")


def _length(n_words):
    """Documents are held against others of a length within a factor of 2."""
    return F.floor(F.log2(n_words.cast("double"))).cast("int")


def cuts(rows: DataFrame, spreads: float = SPREADS, least_excess: float = LEAST_EXCESS, least_group: int = LEAST_GROUP) -> DataFrame:
    """(of, lang, length, kind, cut) from the distances of rows, by language and length (of 0), length (1), and for all (2):
    the median, and `spreads` times what the third quartile lies above it, least_excess at least. Distances are
    counted in STEPS steps; languages and lengths of fewer than least_group documents have no cut."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_distance").alias("d")) for k in ("class", "word")]))
    steps = rows.where("class_distance is not null").select("lang", _length(F.col("n_words")).alias("length"), each.alias("x"))
    steps = steps.groupBy("lang", "length", F.col("x.kind").alias("kind"), F.round(F.col("x.d") * STEPS).cast("int").alias("step")).agg(F.count("*").alias("n"))
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), a.alias("lang"), b.alias("length")) for i, (a, b) in enumerate([(F.col("lang"), F.col("length")), (F.lit(None).cast("string"), F.col("length")), (F.lit(None).cast("string"), F.lit(None).cast("int"))])]))
    steps = steps.select("kind", "step", "n", every.alias("g")).groupBy("g.of", "g.lang", "g.length", "kind", "step").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("of", "lang", "length", "kind")
    steps = steps.withColumn("upto", F.sum("n").over(group.orderBy("step"))).withColumn("all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("step"))) / STEPS
    found = steps.groupBy("of", "lang", "length", "kind").agg(at(0.5).alias("q2"), at(0.75).alias("q3"), F.first("all").alias("n")).where((F.col("n") >= least_group) | (F.col("of") == 2))
    return found.select("of", "lang", "length", "kind", (F.col("q2") + F.greatest(spreads * (F.col("q3") - F.col("q2")), F.lit(least_excess))).alias("cut"))


def quality_rules(docs: DataFrame, least_words: int = JS_LEAST_WORDS, common: int = COMMON, spreads: float = SPREADS, least_excess: float = LEAST_EXCESS, least_group: int = LEAST_GROUP) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance).

    For each row of docs (doc_id, text, lang). base_failed: under 10 words, or over 20 % of the words in repeated 5-word
    windows. The others of least_words words or more are held against their language, by the Jensen-Shannon distance of two
    histograms: character classes, and the language's `common` most frequent words among themselves. A document is not kept if either
    distance lies beyond the cut for its language and length, see references and cuts; both follow from all
    documents that didn't fail. Shorter ones are kept, and have no distances.
    A null lang is a language of its own. Null and empty texts have no words and fail. A text without any common
    word is at distance 1. Repeated rows each give a row and count in the reference; no documents give no rows.
    """
    refs = written(references(docs, least_words, common), "references")
    rows = written(distances(docs, refs, least_words), "measured")
    limits = written(cuts(rows, spreads, least_excess, least_group), "cuts")
    limits = limits.groupBy("of", "lang", "length").agg(*[F.max(F.when(F.col("kind") == k, F.col("cut"))).alias(f"{k}{n}") for n, k in enumerate(("class", "word"))])
    rows = rows.withColumn("length", _length(F.greatest("n_words", F.lit(1))))
    # As many rows as there are languages times lengths: 4096 times 40 at most.
    for of, keys in enumerate((["lang", "length"], ["length"], [])):
        some = F.broadcast(limits.where(F.col("of") == of).select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("class0").alias(f"class_cut{of}"), F.col("word1").alias(f"word_cut{of}")))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
        rows = rows.join(some, on, "left").drop(*[f"of_{k}" for k in keys])
    beyond = lambda k: F.col(f"{k}_distance") > F.coalesce(*[F.col(f"{k}_cut{of}") for of in range(3)])
    away = F.coalesce(beyond("class") | beyond("word"), F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~away).alias("kept"), "class_distance", "word_distance")
