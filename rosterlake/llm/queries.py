"""The registered queries of the text operators: (spark, sf_dir) to a DataFrame.

Each applies an operator of this package to its whole table and derives the columns of its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import (
    alignment,
    bpe,
    decontaminate,
    jaccard_join,
    language_id,
    licenses,
    mixing,
    quality_model,
    quality_rules,
    resample,
    secret_scan,
    suffix_dedup,
    toxicity,
)
from rosterlake.llm.columns import documents, sha256_hex
from rosterlake.llm.labels import in_fold, known_labels
from rosterlake.llm.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.round_trip(documents(spark, sf_dir))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(listed).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.search(documents(spark, sf_dir), items)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        sha256_hex(F.col("kept")).alias("kept_sha256"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents(spark, sf_dir)
    counts = language_id.learn(docs.filter(~in_fold("doc_id", 3, 1)))
    found = language_id.identify(docs, counts)
    return found.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "languages")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))

    def number(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        sha256_hex(secret_scan.span_text(F.col("base"))).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["example"])).cast("long").alias("n_examples"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = known_labels(labels.filter(~in_fold("doc_id", 4, 2)), "quality")
    scored = quality_model.classify(documents(spark, sf_dir), known)
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return scored.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", predicted)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = known_labels(labels.filter(~in_fold("doc_id", 5, 0)), "toxic")
    scored = toxicity.classify(documents(spark, sf_dir), known)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", predicted)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample.resample(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_source_mixing": op13_source_mixing,
}
