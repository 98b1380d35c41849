"""The corpus pipeline: toxicity, shared lines, near copies, benchmark passages, mixing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm import decontamination, line_dedup, near_duplicates, source_mix, toxicity
from lineloom.workspace import Workspace

# Near copies of the corpus have a similarity of 0.8 or more; with these bands a pair at 0.8 is missed with a chance below 1e-6
NEAR_PERCENT = 80
NEAR_BANDS = 46
NEAR_ROWS = 6


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.with_kept_text(line_dedup.drop_shared_lines(docs), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.drop_near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS, rows=NEAR_ROWS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of every remaining document the mix takes, and which shards it goes to."""
    return source_mix.mix_report(*source_mix.mix_plan(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# Training and hashing are outside SQL; the tests compare the stages with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on; each result is a table of the shared folder, so a lost executor costs a re-read."""
    workspace = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = workspace.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
