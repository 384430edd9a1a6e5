"""Token counts as delta-maintained rollups with idempotent batch commits."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")


def signed(changes: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) summed over changes (change, source, lang, tokenizer, tokens, old_source, old_lang, old_tokens).

    insert counts +1 document and its tokens, delete -1 and minus its tokens, revise takes the old count from
    the old source and language and adds the new one. Null tokens count as 0; null keys are a group of their own. Any other
    change fails. Sums are built in each task before the shuffle, so one source may hold any share of the rows.
    """
    sums = lambda sign, source, lang, tokens: F.struct(F.lit(sign).cast("long").alias("docs"), F.col(source).alias("source"), F.col(lang).alias("lang"), (sign * F.coalesce(F.col(tokens), F.lit(0))).cast("long").alias("tokens"))
    plus, minus, old = sums(1, "source", "lang", "tokens"), sums(-1, "source", "lang", "tokens"), sums(-1, "old_source", "old_lang", "old_tokens")
    each = F.when(F.col("change") == "insert", F.array(plus)).when(F.col("change") == "delete", F.array(minus)).when(F.col("change") == "revise", F.array(old, plus))
    each = each.otherwise(F.raise_error(F.concat(F.lit("no such change: "), F.coalesce(F.col("change"), F.lit("null")))).cast("array<struct<docs: bigint, source: string, lang: string, tokens: bigint>>"))
    return changes.select("tokenizer", F.explode(each).alias("x")).groupBy("x.source", "x.lang", "tokenizer").agg(F.sum("x.docs").alias("docs"), F.sum("x.tokens").alias("tokens"))


class Rollup:
    """Totals of a folder of committed batches.

    A batch is one table of sums, written under a temporary name and then renamed to its id, so it is there whole or not
    at all; a batch whose id is there already is not applied again. compact() folds the batches so far into
    one base table that lists them.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(folder))

    def _names(self, prefix: str) -> list[str]:
        return sorted(n for x in self._fs.listStatus(self._path(self.folder)) if (n := x.getPath().getName()).startswith(prefix))

    def _base(self) -> str | None:
        """The newest base."""
        return (self._names("base-") or [None])[-1]

    def _held(self, base: str | None, ids: list[str]) -> set[str]:
        """Those of ids that the base holds already; its list of all ids, which only grows, stays where it is."""
        if base is None or not ids:
            return set()
        return {r[0] for r in self.spark.read.schema("id string").parquet(f"{self.folder}/{base}/ids").where(F.col("id").isin(ids)).collect()}

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits a batch; False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
            raise ValueError(f"no batch id: {batch_id!r}")
        final = self._path(f"{self.folder}/batch-{batch_id}")
        if self._fs.exists(final) or self._held(self._base(), [batch_id]):
            return False
        temp = f"{self.folder}/_temporary-{uuid.uuid4().hex}"
        signed(changes).where("docs != 0 or tokens != 0").write.parquet(temp)
        if self._fs.exists(final) or not self._fs.rename(self._path(temp), final):
            self._fs.delete(self._path(temp), True)
            return False
        return True

    _SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

    def _sums(self, base: str | None, ids: list[str]) -> DataFrame:
        paths = [f"{self.folder}/batch-{i}" for i in ids] + ([f"{self.folder}/{base}/sums"] if base else [])
        rows = self.spark.read.schema(self._SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self._SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")

    def _open(self) -> tuple[str | None, list[str]]:
        """The newest base, and the committed batches that aren't in it."""
        base = self._base()
        ids = [n.removeprefix("batch-") for n in self._names("batch-")]
        held = self._held(base, ids)
        return base, [i for i in ids if i not in held]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches; groups that came to nothing are left out."""
        return self._sums(*self._open())

    def compact(self) -> None:
        """Writes a new base, then removes the batches that it holds. A crash in between leaves batches that the base's list rules out."""
        base, ids = self._open()
        if not ids:
            return
        name = f"base-{int(base.removeprefix('base-')) + 1 if base else 1:08d}"
        temp = f"{self.folder}/_temporary-{uuid.uuid4().hex}"
        self._sums(base, ids).write.parquet(f"{temp}/sums")
        listed = self.spark.createDataFrame([(i,) for i in ids], "id string")
        if base:
            listed = listed.unionAll(self.spark.read.schema("id string").parquet(f"{self.folder}/{base}/ids"))
        listed.write.parquet(f"{temp}/ids")
        if not self._fs.rename(self._path(temp), self._path(f"{self.folder}/{name}")):
            raise OSError(f"{name} can't be published")
        for i in ids:
            self._fs.delete(self._path(f"{self.folder}/batch-{i}"), True)
