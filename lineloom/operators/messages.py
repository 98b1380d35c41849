"""From message text to distinct signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lineloom.functions.masking import marked_length, marked_to_tokens, with_signature
from lineloom.plans.presets import Preset


def preprocess(df: DataFrame, preset: Preset, column: str = "Content") -> DataFrame:
    """Add ``Signature`` (marked string) and ``NTokens``."""
    df = with_signature(df, column, preset.masks, preset.splitters, preset.leading_digit, preset.keep_words)
    return df.withColumn("NTokens", marked_length(F.col("Signature")))


def with_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("Tokens", marked_to_tokens(F.col("Signature")))


def partition_by_length(df: DataFrame) -> DataFrame:
    """Messages only ever meet messages of their own token count."""
    return df.withColumn("Bucket", F.col("NTokens").cast("string"))


def signature_table(lines: DataFrame) -> DataFrame:
    """Distinct signatures with count, first and last line.  ``First`` is unique and serves as the signature's id."""
    return lines.groupBy("Bucket", "Signature").agg(
        F.count(F.lit(1)).alias("n"), F.min("LineId").alias("First"), F.max("LineId").alias("Last")
    )
