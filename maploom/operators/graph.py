"""Iterative operators on links: components, paths out of segments; and numbers in an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maploom.plans.storage import stored


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of links (a, b): root is the least node that can be reached.

    Each round takes the least label among a node's neighbours, then the label of that label, so long chains halve.
    """
    both = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    for _ in range(max_rounds):
        least = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("low"))
        new = labels.join(least, labels.node == least.a).select("node", F.least("root", "low").alias("next"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = stored(new.join(jump, "next", "left").select("node", F.least("next", "far").alias("root"), "was"), "labels")
        labels = new.select("node", "root")
        if not new.where("root != was").limit(1).count():
            return labels
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def ranked(links: DataFrame, keys: Sequence[str] = (), max_rounds: int = 64) -> DataFrame:
    """keys, a, path, pos, closed for the segments of directed links (keys..., a, b), each a at most once and each b at most once.

    path names the path that a segment lies on; pos counts from its start. Paths that end are ranked by how far their
    end is; rings are cut at their least node first. Distances double in each round, so a path of n segments takes
    log2(n) rounds of one join, however long it is.
    """
    keys = list(keys)
    links = stored(links.select(*keys, "a", "b"), "segments")

    def doubled(rows: DataFrame) -> DataFrame:
        """keys, a, end, far, low: the last node reached, its distance, and the least node on the way."""
        rows = rows.select(*keys, "a", F.col("b").alias("end"), F.lit(1).cast("long").alias("far"), F.least("a", "b").alias("low"))
        most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        for _ in range(min(max_rounds, max(1, int(most).bit_length() + 1))):
            on = rows.select(*keys, F.col("a").alias("end"), F.col("end").alias("end2"), F.col("far").alias("far2"), F.col("low").alias("low2"), F.lit(True).alias("on"))
            rows = stored(rows.join(on, [*keys, "end"], "left").select(*keys, "a", F.when(F.col("on"), F.col("end2")).otherwise(F.col("end")).alias("end"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.least("low", "low2").alias("low")), "doubled")
        return rows

    first = doubled(links)
    # On a ring the end is always some segment's start; on an open path it never is.
    starts = links.select(*keys, F.col("a").alias("end"))
    rings = first.join(starts, [*keys, "end"], "left_semi").select(*keys, "a", "low")
    opened = first.join(starts, [*keys, "end"], "left_anti").select(*keys, "a", F.col("end").alias("path"), "far", F.lit(False).alias("closed"))
    cut = links.join(rings, [*keys, "a"]).withColumn("b", F.when(F.col("b") == F.col("low"), F.lit(None)).otherwise(F.col("b")))
    turns = doubled(cut.select(*keys, "a", "b")).select(*keys, "a", "far") if rings.limit(1).count() else None
    every = opened
    if turns is not None:
        every = opened.unionByName(rings.join(turns, [*keys, "a"]).select(*keys, "a", F.col("low").alias("path"), "far", F.lit(True).alias("closed")))
    last = every.groupBy(*keys, "path", "closed").agg(F.max("far").alias("most"))
    return every.join(last, [*keys, "path", "closed"]).select(*keys, "a", "path", (F.col("most") - F.col("far")).cast("int").alias("pos"), "closed")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with the rows' numbers from 1 on in an order. Rows are dealt by ranges of it, each range is numbered by itself, and the ranges'
    sizes, a row a partition, say where each begins; so no task holds them all."""
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(begins), "_range").withColumn(name, (own + F.col("_before")).cast("int")).drop("_range", "_before")
