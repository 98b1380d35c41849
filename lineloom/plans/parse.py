"""Raw lines to structured events and templates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from lineloom.operators.messages import partition_by_length, preprocess
from lineloom.operators.mining import assign_templates, mine_templates, mined_template_counts
from lineloom.operators.parameters import with_literals, with_parameters
from lineloom.plans.presets import Preset
from lineloom.sources.formats import parse_log_lines
from lineloom.workspace import Workspace


class ParsedLog(NamedTuple):
    structured: DataFrame
    templates: DataFrame


def number_across_files(lines: DataFrame) -> DataFrame:
    """``LineId`` over all files, from ``SourceFile`` (kept as ``__file``) and the number ``__physical`` inside it.

    One row for each file is summed up in file order; the lines themselves are not sorted.
    """
    files = lines.groupBy("SourceFile").agg(F.max("__physical").alias("last"))
    before = Window.partitionBy().orderBy("SourceFile").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("SourceFile", F.coalesce(F.sum("last").over(before), F.lit(0)).alias("__before"))
    numbered = lines.join(files, "SourceFile").withColumn("LineId", F.col("__before") + F.col("__physical"))
    return numbered.drop("__before").withColumnRenamed("SourceFile", "__file")


def parse_messages(
    messages: DataFrame,
    preset: Preset,
    mode: str = "leader",
    collapse_wildcards: bool = True,
    refine: bool = False,
    window: int = 65_536,
) -> ParsedLog:
    """From ``LineId, Content, ...`` to the structured log and its template table.

    ``LineId`` must be unique, or there is a ``SourceFile`` within which it is: lines are then mined in file and line order, and
    the result has both columns as they were.
    """
    if "SourceFile" in messages.columns:
        numbered = messages.withColumnRenamed("LineId", "__physical")
        parsed = parse_messages(
            number_across_files(numbered), preset, mode, collapse_wildcards, refine, window
        )
        structured = parsed.structured.drop("LineId").withColumnRenamed("__physical", "LineId")
        return ParsedLog(structured.withColumnRenamed("__file", "SourceFile"), parsed.templates)
    # two passes follow, one over the signatures and one over whole lines; reading them back is far cheaper than
    # matching the header and mask patterns of every line twice
    ws = Workspace(messages.sparkSession)
    lines = ws.table(partition_by_length(preprocess(messages, preset)), "lines", codec="zstd")
    mining = mine_templates(
        lines.select("LineId", "Bucket", "Signature"), preset.method, preset.st, preset.n, mode, refine, window
    )
    literals = None
    if preset.keep_para:
        # cut once per template, before they reach the lines
        literals = with_literals(mining.clusters.select("EventTemplate").distinct(), collapse_wildcards)
    structured = assign_templates(lines, mining, literals).drop("Bucket", "Signature", "NTokens")
    if preset.keep_para:
        structured = with_parameters(structured)
    return ParsedLog(structured, mined_template_counts(mining))


def parse_logs(raw: DataFrame, preset: Preset, column: str = "value", **options) -> ParsedLog:
    """D8 from raw numbered lines (``LineId`` and ``column``)."""
    return parse_messages(parse_log_lines(raw, preset.log_format, column), preset, **options)
