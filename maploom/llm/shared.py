"""Helpers that all operators of this subpackage use: shared folders, files, words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space. bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none (tests, one machine) a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="maploom-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = f"file://{_own[0]}"
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root, removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/maploom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is read again at will."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of a plain local path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of one input table; any others, whatever their names, are not read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with as many marks behind them as it takes for docs to have no such column."""
    have, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n in have:
            n += "_"
        out.append(n)
    return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


class Cut(NamedTuple):
    """Texts cut into words: the different words, each word's place among them, and where each text's words begin and end."""

    words: list[bytes]
    index: np.ndarray
    bounds: np.ndarray


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def cut_words(texts: Sequence[bytes | None], blanks: bool = False) -> Cut:
    """The texts' words, cut like bytes.split(); with blanks, the white space before a word is part of it, and what is left
    at a text's end a word of its own. About 2 GB of text at most."""
    import pyarrow as pa

    texts = [t or b"" for t in texts]
    # A line end behind each text keeps words of two texts apart.
    flat = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    space = _BLANK[flat]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if blanks:
        # A piece begins where white space or a text begins.
        first = space.copy()
        first[1:] &= ~space[:-1]
        if len(first):
            first[np.concatenate([[0], ends[:-1]])] = True
            first[ends - 1] = False
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False
        starts = np.flatnonzero(first & inside)
    else:
        inside = ~space
    # The pieces side by side, without what lies between them.
    kept = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(kept[starts], kept[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside])]).dictionary_encode()
    return Cut(words.dictionary.to_pylist(), words.indices.to_numpy(), np.concatenate([[0], np.searchsorted(starts, ends)]))
