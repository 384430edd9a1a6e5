"""Quality classifier: Bradley-Terry scores learned from preference pairs."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.llm.shared import as_bytes, written

#: Labelled rows that training looks at, those with the least hash of their id; pairs drawn from them; the score at which a document counts as 1.
MOST_ROWS, PAIRS, CUT, SEED = 20_000, 60_000, 0.3, 20240101
_BYTE = np.zeros((256, 10))
for _b in range(256):
    _BYTE[_b] = [97 <= _b <= 122, 65 <= _b <= 90, 48 <= _b <= 57, _b in b" \t\v\f", _b in b"\n\r", _b == 33, _b in b"|", _b in b"#*$%&<>@^~_=+\\{}[]/", _b in b".,;:", _b >= 128]
FEATURES = ("log_words", "word_length", "long_words", "lower", "upper", "digits", "blanks", "line_ends", "exclaims", "bars", "symbols", "marks", "other",
            "distinct_words", "top_word", "same_next", "distinct_pairs", "dup_lines", "line_words", "capitals_only", "ends_in_symbol")


def features(text: bytes | None) -> list[float]:
    """The numbers that a score is made of, from the text alone; zeros if there is no word."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _BYTE / len(text)
    often = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), np.int64, n)
    symbol_end = sum(k for w, k in often.items() if w[-1] in b"#*$%&<>|!")
    upper = sum(k for w, k in often.items() if w.isupper() and len(w) > 1)
    root = math.sqrt
    return [math.log(n), float(min(lengths.mean(), 40)), float((lengths > 20).mean()), share[0], root(share[1]), root(share[2]), share[3], root(share[4]), root(share[5]), root(share[6]), root(share[7]), share[8], share[9],
            len(often) / n, root(max(often.values()) / n), root(same / max(1, n - 1)), pairs / max(1, n - 1), root(1 - len(set(lines)) / len(lines)), math.log(n / len(lines)), upper / n, symbol_end / n]


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(bias + sum(weight * feature)))); it is CUT at the quantile chosen."""

    weights: tuple[float, ...]
    bias: float

    def score(self, feature: Column) -> Column:
        z = F.lit(self.bias)
        for i, w in enumerate(self.weights):
            z = z + F.lit(w) * feature[i]
        return 1 / (1 + F.exp(-z))


def train(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = SEED, ridge: float = 1e-3) -> Model:
    """Learns P(a before b) = 1 / (1 + exp(s(b) - s(a))) over pairs of a good and a bad row, by Newton steps.

    The threshold is the score quantile that tells the training rows apart best, both labels counting alike. With one label
    only, every document scores 0.5.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model((0.0,) * x.shape[1], 0.0)
    mean, std = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(std > 1e-9, std, 1)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    at = np.quantile(s, np.linspace(0, 1, 401))
    fit = [((s[good] >= t).mean() + (s[bad] < t).mean()) for t in at]
    best = np.flatnonzero(np.array(fit) >= max(fit) - 1e-12)
    threshold = at[best[len(best) // 2]]
    # The middle between the rows on either side of the quantile.
    below, above = s[s < threshold], s[s >= threshold]
    if len(below) and len(above):
        threshold = (below.max() + above.min()) / 2
    w = np.where(std > 1e-9, w / np.where(std > 1e-9, std, 1), 0)
    return Model(tuple(w.tolist()), float(math.log(CUT / (1 - CUT)) - threshold - mean @ w))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features_of(docs: DataFrame, extra: list[str]) -> DataFrame:
    """docs (text, extra...) with features for the text."""

    def run(batches):
        for batch in batches:
            x = pa.array([features(t) for t in as_bytes(batch.column(0))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, *batch.columns[1:]], ["features", *extra])

    rows = docs.select(F.col("text").cast("string").alias("text"), *extra)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, "features array<double>, " + kinds)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of labels (doc_id, quality) that may be learned from: a document with several counts as good if they are so
    on average; null ids, null labels and held-out documents are left out."""
    by = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    return by.where(~held_out(F.col("doc_id")))


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, label) of the documents that training looks at: of the ids that docs and labels share, the most_rows whose hash is
    least. Labels without a document use nothing up."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return written(labelled(labels).join(ids, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "sample")


def fit(rows: DataFrame, some: DataFrame, pairs: int = PAIRS, seed: int = SEED) -> Model:
    """Learns from rows (doc_id, features) of some (doc_id, label). Of repeated ids the row with the least features counts, so
    that the same rows give the same model."""
    # some has most_rows rows at most, twelve bytes each.
    got = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("features"), F.min("label")).collect()
    got.sort(key=lambda r: r[0])
    return train(np.array([r[1] for r in got]).reshape(-1, len(FEATURES)), np.array([r[2] for r in got]), pairs, seed)


def classify(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, pairs: int = PAIRS, seed: int = SEED) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    score: 0 to 1, from the text alone, higher where label 1 is likelier; predicted: 1 if it is 0.3 or more.
    Labels of held-out documents, a fifth by crc32 of the id, are not learned from; a null id is not held out and not learned from.
    Null and empty texts score like a text of all-zero features. Repeated rows each give a row; without labels all score 0.5.
    """
    rows = written(_features_of(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")), ["doc_id"]), "features")
    score = fit(rows, sample(rows, labels, most_rows), pairs, seed).score(F.col("features"))
    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, pairs: int = PAIRS, seed: int = SEED) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that are predicted 1, all columns kept.

    Training reads the texts of the labelled sample only; then one pass scores and filters, and no text moves.
    """
    some = sample(docs, labels, most_rows)
    texts = docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")
    model = fit(written(_features_of(texts, ["doc_id"]), "features"), some, pairs, seed)
    at, weights, cut = docs.columns.index("text"), np.array(model.weights), math.log(CUT / (1 - CUT))

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in as_bytes(batch.column(at))]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(x @ weights + model.bias >= cut, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
