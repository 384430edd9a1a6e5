"""Each stage of the corpus pipeline against a plain version, on its own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from maploom.llm import classifier, mixing
from maploom.llm.queries import tokenizer_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = re.findall(brute.WS, brute.lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def near_groups(docs, similarity):
    """doc_id -> smallest doc_id of its group, by all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    pairs = Counter((a, b) for ds in where.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    for (a, b), n in pairs.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= similarity:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in sets}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], SF).cache())
    return out


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources", "token ids"]


def test_quality(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in classifier.classify(stages[0], labels).where("predicted = 1").collect()}
    got = [r.doc_id for r in stages[1].collect()]
    assert set(got) == want and len(got) == len(want)
    marked = {r.doc_id: r.quality for r in labels.collect()}
    wrong = [d for d, q in marked.items() if (d in want) != (q == 1)]
    assert len(wrong) <= 0.03 * len(marked)


def test_near_duplicates(stages):
    docs = [(r.doc_id, r.text) for r in stages[1].collect()]
    kept = {r.doc_id for r in stages[2].collect()}
    assert kept == set(near_groups(docs, 0.8).values())


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    """Rows that share an id but not their text, rows without an id, rows alike in all but other columns, and clashing column names."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    data = [(1, a, "u", 1, 1, 1), (1, b, "u", 1, 1, 1), (2, a, "u", 2, 2, 2), (3, b, "u", 3, 3, 3), (None, c, "u", 4, 4, 4), (None, c, "u", 4, 4, 4), (None, a, "u", 5, 5, 5), (7, c, "u", 6, 6, 6), (8, d, "v", 7, 7, 7), (8, d, "u", 7, 7, 7), (None, None, "u", 8, 8, 8), (9, "", "w", 9, 9, 9)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, `_rows` int, h int, `of` int")
    outs = []
    for got in (corpus_pipeline.near_duplicates(spark, df, SF), corpus_pipeline.near_duplicates(spark, df.repartition(4), SF)):
        assert got.columns == df.columns
        out = sorted((r.doc_id, r.text, r.source) for r in got.collect())
        assert [x[:2] for x in out] == sorted([(1, a), (1, b), (7, c), (8, d), (9, "")])
        outs.append(out)
    assert outs[0] == outs[1]


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {x[0] for x in brute.contamination([(r.doc_id, r.text) for r in stages[2].collect()], items) if not x[5]}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_mixture(stages):
    count = lambda rows: Counter((r.doc_id, r.text, r.source) for r in rows)
    before, after = count(stages[3].collect()), count(stages[4].collect())
    assert set(after) <= set(before) and max(after.values()) <= 3
    size = lambda t: len(re.findall(brute.WS, t or ""))
    target = {r.source: r.target for r in mixing.targets(stages[3].select("source", mixing.n_words(stages[3].text).alias("size"))).collect()}
    for s, t in target.items():
        words = sum(n * size(text) for (_, text, source), n in after.items() if source == s)
        assert abs(words - t) <= max(size(text) for _, text, source in before if source == s) + 1


def test_token_ids(stages):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in stages[4].collect():
        ids = [*tool.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = stages[5].orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0
