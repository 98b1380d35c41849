"""Running template counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def template_counts_stream(structured: DataFrame) -> DataFrame:
    """``EventId, EventTemplate, Occurrences`` for ``update`` or ``complete`` mode.

    The aggregate combines inside each task before the shuffle, so a template that holds most of a micro-batch sends
    one row per task.
    """
    return structured.groupBy("EventId", "EventTemplate").agg(F.count(F.lit(1)).alias("Occurrences"))
