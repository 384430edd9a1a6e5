"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.llm import classifier, decontaminate, mixing, quality_rules, rollups, secrets_scan, simhash, token_counts, tokens, url_rules, warc
from maploom.llm.shared import new_folder, table, written


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages", ["page_id", "url", "html"]), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    return out.withColumn("spans", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ","))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", ["page_id", "url"])
    labelled = url_rules.labelled_pages(pages, table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]))
    return url_rules.judge_urls(pages, labelled)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.secrets(table(spark, sf_dir, "documents", ["doc_id", "text"]))


#: Tokenizer versions of the rollup, and their files.
VERSIONS = {"word_bpe_49k": "word_bpe_49k.json", "byte_bpe_50k": "byte_bpe_50k.tiktoken"}


def token_rollup(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) of docs (doc_id, text, lang, source) after four batches: all documents are
    loaded, toxic ones deleted, other low-quality ones revised to their counts without symbols, and the deletes delivered twice.

    Labels (doc_id, quality, toxic) say toxic if any toxic is 1, low if any quality is 0; a null or missing one says neither.
    Every row of a repeated id is deleted or revised. Documents without an id have no labels.
    """
    import public_tokenizers

    spark = docs.sparkSession
    paths = {v: public_tokenizers.path(f) for v, f in VERSIONS.items()}
    by = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic"), F.coalesce(F.min("quality") == 0, F.lit(False)).alias("low"))
    rows = written(token_counts.token_counts(docs, paths, quality_rules.SYMBOLS), "counts").join(by, F.col("doc_id") == F.col("of"), "left")
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col("tokens")[i].alias("n"), F.col("bare")[i].alias("b")) for i, v in enumerate(VERSIONS)]))
    rows = rows.select("lang", "source", F.coalesce("toxic", F.lit(False)).alias("toxic"), F.coalesce("low", F.lit(False)).alias("low"), each.alias("t")).select("lang", "source", "toxic", "low", "t.*")

    def change(kind: str, some: DataFrame, tokens: str) -> DataFrame:
        return some.select(F.lit(kind).alias("change"), "source", "lang", "tokenizer", F.col(tokens).alias("tokens"), F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("n").alias("old_tokens"))

    rollup = rollups.Rollup(spark, new_folder(spark, "rollup"))
    rollup.apply("0001-load", change("insert", rows, "n"))
    rollup.apply("0002-toxic", change("delete", rows.where("toxic"), "n"))
    rollup.apply("0003-bare", change("revise", rows.where("low and not toxic"), "b"))
    rollup.apply("0002-toxic", change("delete", rows.where("toxic"), "n"))
    return rollup.totals()


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup(table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]), table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))
    return out.drop("class_distance", "word_distance")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "labels", ["doc_id", "quality"]))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents", ["doc_id", "text"]), folder, tokenizer_path())
    return tokens.read_tokens(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_mixing, op3_simhash, op4_decontamination, op5_url_rules, op6_secrets, op7_token_rollup, op8_quality_rules, op9_quality_classifier, op10_token_ids)}


OP1_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) d from pages),
     r as (select d, max(page_id) rep from p where n >= 1000 group by d)
select p.page_id, p.n::bigint payload_bytes, p.d payload_digest,
       case when r.rep > p.page_id then 'revisit' else 'response' end record_type,
       case when r.rep > p.page_id then r.rep end refers_to
from p left join r on p.d = r.d
"""

def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL}
