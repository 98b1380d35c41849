"""Blank-separated words of a message: the input of the miners that know no delimiter tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lineloom.functions.masking import mark_tokens, marked_length, mask_patterns
from lineloom.operators.messages import partition_by_length, signature_table, with_tokens
from lineloom.workspace import Workspace


def word_lines(messages: DataFrame, masks: Sequence[str] = (), column: str = "Content") -> DataFrame:
    """``LineId, Bucket, Signature`` with one token per word; messages of equal length share a bucket."""
    marked = F.coalesce(mark_tokens(mask_patterns(F.col(column), masks), r"\s+"), F.lit(""))
    lines = messages.select("LineId", marked.alias("Signature"))
    return partition_by_length(lines.withColumn("NTokens", marked_length(F.col("Signature")))).drop("NTokens")


def distinct_messages(lines: DataFrame, ws: Workspace) -> DataFrame:
    """The written signature table with tokens."""
    return ws.table(with_tokens(signature_table(lines)), "distinct-messages", "First")
