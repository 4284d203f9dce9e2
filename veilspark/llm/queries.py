"""The queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import centroids, cuckoo_dedup, decontam, infill, kneser_ney, langid, licenses, metric_join, minhash, pieces, pii, token_rollup, toxicity as severity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir))


def op2_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo_dedup.exact_dedup(_docs(spark, sf_dir))


def op3_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_docs(spark, sf_dir))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_docs(spark, sf_dir))


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity.toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.language_model_scores(_docs(spark, sf_dir), kneser_ney.ORDER)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_decode(_docs(spark, sf_dir).select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_docs(spark, sf_dir))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_rollup.rollup_of_corpus(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(_docs(spark, sf_dir), with_output=False)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.jaccard_components(_docs(spark, sf_dir))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_cuckoo_dedup, op3_hyperdimensional_langid, op4_pii_spans, op5_template_decontamination, op6_toxicity_severity, op7_kneser_ney, op8_sentencepiece, op9_license_scan, op10_token_rollup, op11_fill_in_middle, op12_jaccard_join, op13_centroid_clusters)}

ORACLES: dict[str, str] = {"op2_cuckoo_dedup": cuckoo_dedup.ORACLE, "op11_fill_in_middle": infill.ORACLE, "op12_jaccard_join": metric_join.ORACLE, "op13_centroid_clusters": centroids.ORACLE}
