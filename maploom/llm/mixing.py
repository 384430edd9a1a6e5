"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

Every document of a source has the same expected number of copies, its target over its size. The whole
part is taken outright. The fractional parts are rounded together: two documents meet, one passes words'
worth of probability to the other, at random but fair, until the probability of one is 0 or 1; the
other meets the next. The expected words of a source never change, so it ends within one document of
its target. Blocks of documents are folded at once, what is left of each block goes to the next level
of a tree, and the last document of a source is drawn alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maploom.llm.shared import fresh, n_words, written

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents folded together in one row.
BLOCK = 64
SEED = 20240101


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target) of sizes (source, size).

    Sources weigh in turn by code point, null last. Targets share the sum of sizes by weight, but stop at
    most times their source's size; the excess goes to the others by weight. In order of cap over weight the
    words per weight rise while sources are capped and fall after, so the greatest is the final one.
    Empty sources have target 0.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n"))
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
    by = by.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return by.select("source", "source_size", "n", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"), (F.col("level") * F.col("weight") >= F.col("cap")).alias("full"))


#: Two documents meet: c is carried, x is next; w and v are their words, c.p and x.p their probabilities.
_MEET = """transform(array(named_struct('c', acc.c, 'x', x, 'w', cast(acc.c.size as double), 'v', cast(x.size as double))), z -> named_struct('z', z,
 'a', (1 - z.c.p) * z.w, 'b', z.x.p * z.v, 'd', z.c.p * z.w, 'e', (1 - z.x.p) * z.v,
 'u', (xxhash64({seed}, z.c.key, z.c.size, z.x.key, z.x.size) & 9007199254740991) / 9007199254740992D))[0]"""
_MOVED = """transform(array({meet}), m -> if(m.u * (least(m.a, m.b) + least(m.d, m.e)) < least(m.d, m.e),
 array(named_struct('i', m.z.c, 'p', if(m.a <= m.b, 1D, m.z.c.p + m.z.x.p * m.z.v / m.z.w)), named_struct('i', m.z.x, 'p', if(m.b <= m.a, 0D, m.z.x.p - m.a / m.z.v))),
 array(named_struct('i', m.z.c, 'p', if(m.d <= m.e, 0D, m.z.c.p - m.e / m.z.w)), named_struct('i', m.z.x, 'p', if(m.e <= m.d, 1D, m.z.x.p + m.d / m.z.v)))))[0]"""
_FOLD = """aggregate(items, cast(named_struct('c', null, 'out', array()) as struct<c: {item}, out: array<{item}>>),
 (acc, x) -> if(acc.c is null, named_struct('c', x, 'out', acc.out), transform(array({moved}), t -> named_struct(
  'c', try_element_at(transform(filter(t, e -> e.p > 0 and e.p < 1), e -> named_struct('key', e.i.key, 'size', e.i.size, 'p', e.p)), 1),
  'out', concat(acc.out, transform(filter(t, e -> e.p <= 0 or e.p >= 1), e -> named_struct('key', e.i.key, 'size', e.i.size, 'p', if(e.p <= 0, 0D, 1D))))))[0]))"""


def _fold(kind: str, seed: int) -> str:
    item = f"struct<key: {kind}, size: bigint, p: double>"
    return _FOLD.format(item=item, moved=_MOVED.format(meet=_MEET.format(seed=f"{seed}L")))


def copies(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(key, source, size, source_size, target, copies): how often the mix takes each row of sizes (key, source, size).

    One row out for each row in; the same rows give the same result in any order or partitioning. Rows alike in
    key, source and size are rounded as one, so any number of them is no hot group. Rows of size 0 are
    taken as often as the whole part of their source's ratio says. Null keys and null sources are values like any other. No rows give no rows.
    """
    kind = sizes.schema["key"].dataType.simpleString()
    by = written(targets(sizes, weights, most), "targets")
    same = sizes.groupBy("key", "source", "size").agg(F.count("*").alias("m"))
    rows = same.join(by.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ratio = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("full"), F.lit(float(most))).otherwise(F.col("target") / F.greatest("source_size", F.lit(1)))
    rows = rows.withColumn("r", F.least(ratio, F.lit(float(most)))).withColumn("whole", F.floor("r"))
    f = F.col("r") - F.col("whole")
    # Of m rows alike, m * f are due one more copy: the whole part of that now, the rest in the fold.
    rows = rows.withColumn("due", F.when(F.col("size") > 0, F.col("m") * f).otherwise(F.lit(0.0)))
    rows = rows.withColumn("more", F.floor(F.col("due") + 1e-12)).withColumn("p", F.greatest(F.col("due") - F.col("more"), F.lit(0.0)))
    rows = rows.withColumn("p", F.when(F.col("p") < 1e-12, F.lit(0.0)).otherwise(F.col("p")))
    rows = written(rows.select("key", "source", "size", "m", "source_size", "target", "whole", "more", "p", "n"), "ratios")
    n = rows.agg(F.max("n")).first()[0] or 0
    items = rows.where("p > 0").select("source", F.col("n").alias("left"), F.struct("key", "size", "p").alias("i"))
    decided, level = [], 0
    while n > 0:
        blocks = F.ceil(F.col("left") / BLOCK)
        block = F.pmod(F.xxhash64(F.lit(seed + level), "i.key", "i.size"), blocks)
        put = items.select("source", blocks.alias("left"), block.alias("block"), F.struct(F.xxhash64(F.lit(seed), "i.key", "i.size").alias("h"), "i").alias("s"))
        group = put.groupBy("source", "left", "block").agg(F.array_sort(F.collect_list("s")).alias("s")).withColumn("items", F.expr("transform(s, z -> z.i)"))
        group = written(group.select("source", "left", F.expr(_fold(kind, seed + level)).alias("f")), "folded")
        decided.append(group.select("source", F.explode("f.out").alias("i")))
        items = group.where("f.c is not null").select("source", "left", F.col("f.c").alias("i"))
        n, level = (0 if n <= 1 else -(-n // BLOCK)), level + 1
        if n == 1:
            n = 0
    if decided:
        u = F.xxhash64(F.lit(seed + 99), "i.key", "i.size").bitwiseAND((1 << 53) - 1) / float(1 << 53)
        decided.append(items.select("source", F.struct("i.key", "i.size", F.when(u < F.col("i.p"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("p")).alias("i")))
        taken = decided[0]
        for d in decided[1:]:
            taken = taken.unionAll(d)
        taken = taken.where("i.p > 0").select(F.col("i.key").alias("key2"), F.col("source").alias("source2"), F.col("i.size").alias("size2"))
        on = F.col("key").eqNullSafe(F.col("key2")) & F.col("source").eqNullSafe(F.col("source2")) & (F.col("size") == F.col("size2"))
        rows = rows.join(taken, on, "left").withColumn("more", F.col("more") + F.when(F.col("size2").isNotNull(), 1).otherwise(0))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))
    return rows.select("key", "source", "size", "source_size", "target", "whole", "more", each.alias("i")).select(
        "key", "source", "size", "source_size", "target", (F.col("whole") + F.when(F.col("i") <= F.col("more"), 1).otherwise(0)).cast("int").alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, text, source).

    size: words of the text, null 0. taken: words that the mix takes, copies counted. Sources, nulls, repeats
    and empty tables as in targets and copies; other columns are not read.
    """
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("key"), "source", n_words(F.col("text")).alias("size")), "sizes")
    out = copies(sizes, weights, most, seed)
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source, ...) with each row as often as the mix takes it, all columns kept.

    Rows that agree in doc_id, source and text share a decision, on their words together.
    """
    key = F.xxhash64("doc_id", "source", "text")
    sizes = docs.select(key.alias("key"), "source", n_words(F.col("text")).alias("size")).groupBy("key", "source").agg(F.sum("size").alias("size"))
    mark, often_as, nth = fresh(docs, "key", "copies", "nth")
    often = copies(written(sizes, "sizes"), weights, most, seed).where("copies > 0").select(F.col("key").alias(mark), F.col("copies").alias(often_as))
    return docs.withColumn(mark, key).join(often, mark).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(often_as)))).select(*docs.columns)
