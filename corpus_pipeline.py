"""A training corpus from raw documents: STAGES, each over what the one before it kept.

The last stage returns the token files' index; the others return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.llm import classifier, decontaminate, mixing, simhash, tokens
from maploom.llm.queries import tokenizer_path
from maploom.llm.shared import fresh, new_folder, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classifier.accepted(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles agree to 0.8 or more, the one with the smallest doc_id stays, null last;
    of several with that id the one whose text has the least hash; and of rows alike in both, one, by a hash of their other columns."""
    groups = simhash.similar_components(docs.select("doc_id", "text"))
    of, text_of, h, rows = fresh(docs, "of", "text_of", "h", "rows")
    keep = groups.where("doc_id <=> component_id and h = component_h").groupBy(F.col("doc_id").alias(of), F.col("h").alias(text_of)).agg(F.count("*").alias(rows))
    # Which ids stay grows with the documents, so they are never sent to every task, not at small sizes either.
    kept = docs.withColumn(h, F.xxhash64("text")).join(written(keep, "keep").hint("merge"), F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(h) == F.col(text_of)))
    # Repeated rows are few and go to a task by id, one from each task that has any; the others are not dealt out again.
    once = kept.where(F.col(rows) == 1).select(*docs.columns)
    by = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*by)).alias(rows)
    return once.unionAll(kept.where(F.col(rows) > 1).groupBy(of, text_of).agg(row).select(f"{rows}.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of what is left, read back: doc_id, start, n_tokens, ids_crc32."""
    folder = new_folder(spark, "corpus")
    tokens.write_tokens(docs.select("doc_id", "text"), folder, tokenizer_path())
    return tokens.read_tokens(spark, folder)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources", mixture), ("token ids", token_ids)]

#: SQL has neither the classifier nor the hashes; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
