"""Files as rows: any file system that Spark reads, parsed in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, content of files, one row a file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def parsed(files: DataFrame, parse: Callable[[bytes, str], Iterator[tuple]], schema: str) -> DataFrame:
    """path and the rows that parse(content, name) yields for each file; what a file is refused for fails the query by name."""
    names = ["path", *(x.split()[0] for x in _columns(schema))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows, name = [], path.rsplit("/", 1)[-1]
                try:
                    for row in parse(bytes(content), name):
                        rows.append((path, *row))
                        if len(rows) >= 20_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except (ValueError, KeyError, IndexError) as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pd.DataFrame(rows, columns=names)

    return files.select(F.col("path"), F.col("content")).mapInPandas(run, "path string, " + schema)


def _columns(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]
