"""The thin ``opN_*`` queries over the operators of this subpackage, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, html_text, jaccard_join, license_scan, quality, sentencepieces, sharding, substrings, token_files, toxicity


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; only the queries look it up, the operators take a path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes; equal texts are neighbours in the order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    cut = sharding.byte_shards(rows, 40, F.col("size"), [F.col("h"), F.col("doc_id")])
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_documents(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"), end_id=2, with_ids=False)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_path(spark, "tokens")
    manifest = token_files.write_files(documents(spark, sf_dir), folder, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return token_files.read_files(manifest, folder)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id and the tiles that show it."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find(documents(spark, sf_dir), items)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.find(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that has seen no label of the held-out rows."""
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_sharding,
        op2_license_scan,
        op3_quality_rules,
        op4_sentencepiece,
        op5_decontamination,
        op6_html_text,
        op7_token_files,
        op8_jaccard_join,
        op9_substrings,
        op10_toxicity,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.oracle()}
