"""Queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lineloom.llm import (
    best_fit_packing, conversation_repair, decontamination, filter_audit, license_scan, line_dedup, near_duplicates, secret_scan, source_mix, substring_dedup, toxicity,
    url_reputation, vector_search,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark, sf_dir):
    return substring_dedup.removal_report(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op2(spark, sf_dir):
    return line_dedup.line_report(line_dedup.drop_shared_lines(_table(spark, sf_dir, "documents")))


def op3(spark, sf_dir):
    return source_mix.mix_report(*source_mix.mix_plan(_table(spark, sf_dir, "documents")))


def op4(spark, sf_dir):
    """The labelled outcomes are those of ``labels``, whose ids are read as page ids."""
    outcomes = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")
    )
    judged = url_reputation.judge_urls(_table(spark, sf_dir, "pages"), outcomes)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5(spark, sf_dir):
    return license_scan.scan_licences(_table(spark, sf_dir, "documents"))


def op7(spark, sf_dir):
    return secret_scan.secret_report(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


def op6(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return vector_search.nearest_vectors(vectors, vectors.where(F.col("vec_id") % vector_search.EVERY == 0))


def op8(spark, sf_dir):
    found = decontamination.find_contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return decontamination.contamination_report(found)


def op9(spark, sf_dir):
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op10(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.toxicity_report(toxicity.score(docs, model))


def op11(spark, sf_dir):
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12(spark, sf_dir):
    return conversation_repair.repair_report(conversation_repair.damage(_table(spark, sf_dir, "conversations")))


def op13(spark, sf_dir):
    import public_tokenizers

    return best_fit_packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1,
        "op2_line_dedup": op2,
        "op3_source_mix": op3,
        "op4_url_reputation": op4,
        "op5_license_scan": op5,
        "op6_nearest_vectors": op6,
        "op7_secret_scan": op7,
        "op8_benchmark_decontamination": op8,
        "op9_minhash_near_dedup": op9,
        "op10_toxicity": op10,
        "op11_filter_audit": op11,
        "op12_conversation_repair": op12,
        "op13_best_fit_packing": op13,
    }
