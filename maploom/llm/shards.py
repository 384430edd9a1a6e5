"""Deterministic range shards, and files that become visible only when a manifest names them."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.llm.shared import open_fs, written

#: Keys that the driver looks at to place the cuts between shards.
SAMPLE = 20_000

MANIFEST = "shard int, seq int, temp string, file string, records long, bytes long, sha1 string, ids long"
_KINDS = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
_NAMES = [x.split()[0] for x in MANIFEST.split(", ")]


def cuts(keys: DataFrame, weight: int) -> list[tuple]:
    """Keys at which shards begin, after the first, for rows (k, h, w) whose w sum to about weight a shard.

    They follow from the rows alone: rows are drawn by a hash of their key, so the order of rows, partitions
    and runs doesn't matter. Of each 20,000th part of the keys one is looked at.
    """
    n, total = keys.agg(F.count("*"), F.sum("w")).first()
    if not n or total <= weight:
        return []
    every = -(-n // SAMPLE)
    rows = keys.where(F.pmod(F.xxhash64("k", "h"), F.lit(every)) == 0).groupBy("k", "h").agg(F.sum("w")).collect()
    rows = sorted((r[0] is not None, r[0] or 0, r[1], r[2]) for r in rows)
    share = weight * sum(r[3] for r in rows) / total
    out, full = [], 0.0
    for r in rows:
        if full >= share:
            out.append(r[:3])
            full = 0.0
        full += r[3]
    return out


def places(at: list[tuple], k: pa.Array, h: pa.Array) -> np.ndarray:
    """How many cuts are not above each key (k, h); null keys come first."""
    nulls = sum(not c[0] for c in at)
    keys, hashes = np.array([c[1] for c in at], np.int64), np.array([c[2] for c in at], np.int64)
    h = h.to_numpy(zero_copy_only=False)
    none = k.is_null().to_numpy(zero_copy_only=False)
    k = k.fill_null(0).to_numpy(zero_copy_only=False)
    out = nulls + np.searchsorted(keys[nulls:], k, "left")
    last = nulls + np.searchsorted(keys[nulls:], k, "right")
    # Keys that are a cut, or several, are placed by their hash among these.
    for key in np.unique(k[(out < last) & ~none]):
        rows = np.flatnonzero((k == key) & ~none)
        a, b = out[rows[0]], last[rows[0]]
        out[rows] = a + np.searchsorted(hashes[a:b], h[rows], "right")
    out[none] = np.searchsorted(hashes[:nulls], h[none], "right")
    return out.astype(np.int32)


def shard_of(spark: SparkSession, k: Column, h: Column, at: list[tuple]) -> Column:
    """The shard of a row, places as a column."""
    if not at:
        return F.lit(0)
    sent = spark.sparkContext.broadcast(at)

    @F.arrow_udf("int")
    def find(k: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(places(sent.value, k, h), pa.int32())

    return find(k, h)


class File:
    """One output file under a temporary name of its own; row() is its line of the manifest."""

    def __init__(self, folder: str, shard: int, seq: int, suffix: str) -> None:
        self.shard, self.seq = shard, seq
        self.name = f"shard-{shard:06d}-{seq:04d}.{suffix}"
        self.temp = f"_temporary_files/{self.name}.{uuid.uuid4().hex}"
        fs, path = open_fs(folder)
        fs.create_dir(f"{path}/_temporary_files", recursive=True)
        self.stream = fs.open_output_stream(f"{path}/{self.temp}", compression=None)
        self.sha1, self.bytes, self.records, self.ids = hashlib.sha1(), 0, 0, 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.sha1.update(data)
        self.bytes += len(data)

    def row(self) -> pa.RecordBatch:
        self.stream.close()
        values = [self.shard, self.seq, self.temp, self.name, self.records, self.bytes, self.sha1.hexdigest(), self.ids]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _KINDS, strict=True)], _NAMES)


def commit(rows: DataFrame, folder: str) -> DataFrame:
    """Runs the writers behind the manifest rows, names their files, then publishes the manifest.

    A task that runs twice leaves two temporary files; the manifest table keeps the rows of one attempt, only those files
    get their names, and the rest go with the temporary folder. Renaming may be repeated. Readers see nothing until the
    manifest, renamed last, is in place.
    """
    rows = written(rows, "files")

    def rename(batches):
        fs, path = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if fs.get_file_info(f"{path}/{row['temp']}").type != pa.fs.FileType.NotFound:
                    fs.move(f"{path}/{row['temp']}", f"{path}/{row['file']}")
                elif fs.get_file_info(f"{path}/{row['file']}").size != row["bytes"]:
                    raise FileNotFoundError(row["file"])
            yield batch

    spark = rows.sparkSession
    rows.mapInArrow(rename, MANIFEST).write.parquet(f"{folder}/_manifest.tmp")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(hadoop(f"{folder}/_manifest.tmp"), hadoop(f"{folder}/_manifest")):
        raise OSError(f"{folder}/_manifest can't be published")
    fs.delete(hadoop(f"{folder}/_temporary_files"), True)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
