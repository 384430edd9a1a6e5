"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.llm.shared import written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the smallest node of its component.

    Alternating large-star and small-star rounds: each node's neighbours are hung below the
    smallest of them, so paths shrink by a constant factor and the table never grows. Each round
    is a table in the shared folder. A node with very many links only meets its own minimum, by a
    join that adaptive execution can split. Null ends and self-links are dropped; no links give no rows.
    """
    links = (
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNotNull().alias("x"), F.col("b").isNotNull().alias("y"))
        .where("x and y and a != b").select("a", "b").distinct()
    )
    links = written(links, "links")
    mark = _mark(links)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        # Large star: both directions, hang larger neighbours below the smallest.
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: hang smaller neighbours and the node itself below the smallest.
        large = written(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.unionAll(low.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "links")
        was, mark = mark, _mark(links)
        if was == mark:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Two equal marks in a row mean that a round changed nothing."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum((h.bitwiseAND(0x7FFFFFFF)).cast("long")), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first())
