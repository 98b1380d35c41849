"""Template mining and what follows from it: templates on lines, and the template table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from lineloom.functions.text import event_id, render_template
from lineloom.operators.leader import mine_leaders
from lineloom.operators.messages import signature_table, with_tokens
from lineloom.operators.sequential import mine_sequential
from lineloom.plans.joins import hot_keys, spread_join
from lineloom.workspace import Workspace


class Mining(NamedTuple):
    """``members`` maps ``key`` (``Signature`` or ``LineId``) to ``ClusterId`` with its number of lines ``n``;
    ``clusters`` is ``Bucket, ClusterId, Tokens, EventTemplate, EventId``."""

    members: DataFrame
    clusters: DataFrame
    key: str


def mine_templates(
    lines: DataFrame,
    method: str = "combined",
    st: float = 0.4,
    n: int = 3,
    mode: str = "leader",
    refine: bool = False,
    window: int = 65_536,
    known: DataFrame | None = None,
    delimiters: bool = True,
    joint: str = "",
) -> Mining:
    """D2 (``mode='sequential'``) or D3 (``mode='leader'``) over ``LineId, Bucket, Signature``.

    The two differ in what a message is compared with: the template as it stands after all earlier lines, or the
    first message of the cluster.  The leader mode depends on each distinct message once and is the one for large
    data; the sequential mode gives the line-order result exactly.  ``delimiters`` lets delimiter tokens outlive a
    mismatch, ``joint`` is put between the tokens of a rendered template.
    """
    ws = Workspace(lines.sparkSession)
    sigs = ws.table(signature_table(lines), "signatures", "First", codec="zstd")
    if mode == "leader":
        mapping, clusters = mine_leaders(sigs, method, st, n, ws, refine, delimiters)
        ws.drop(sigs)
        members = mapping.select("Signature", "n", "ClusterId")
        key = "Signature"
    elif mode == "sequential":
        members, clusters = mine_sequential(lines, with_tokens(sigs), method, st, n, ws, window, known, delimiters)
        members = members.withColumn("n", F.lit(1).cast("bigint"))
        key = "LineId"
    else:
        raise ValueError(f"mode must be 'leader' or 'sequential', not {mode!r}")
    mining = Mining(members, ws.table(label_clusters(clusters, joint), "rendered"), key)
    ws.sweep()
    return mining


def label_clusters(clusters: DataFrame, joint: str = "") -> DataFrame:
    """Text and id of every cluster's template."""
    text = render_template(F.col("Tokens"), joint)
    return clusters.select("Bucket", "ClusterId", "Tokens", text.alias("EventTemplate")).withColumn(
        "EventId", event_id(F.col("EventTemplate"))
    )


def assign_templates(lines: DataFrame, mining: Mining, extra: DataFrame | None = None) -> DataFrame:
    """``EventId`` and ``EventTemplate`` on every line.  ``extra`` adds columns per ``EventTemplate``."""
    ws = Workspace(lines.sparkSession)
    sizes = mining.members.groupBy("ClusterId").agg(F.sum("n").alias("n"))
    labels = mining.clusters.select("ClusterId", "EventId", "EventTemplate")
    if extra is not None:
        labels = labels.join(extra, "EventTemplate")
    labelled = ws.table(
        spread_join(
            mining.members, labels, ["ClusterId"], hot_keys(sizes, ["ClusterId"], "n"), mining.key
        ),
        "labelled",
    )
    ws.sweep()
    hot = hot_keys(labelled, [mining.key], "n") if mining.key == "Signature" else None
    return spread_join(lines, labelled.drop("n", "ClusterId"), [mining.key], hot, "LineId")


def template_counts(structured: DataFrame, ordered: bool = False) -> DataFrame:
    """``EventId, EventTemplate, Occurrences``; ``ordered`` sorts by first appearance, for a sink."""
    table = structured.groupBy("EventTemplate").agg(
        F.count(F.lit(1)).alias("Occurrences"), F.min("LineId").alias("FirstLine")
    )
    if ordered:
        table = table.orderBy("FirstLine")
    return table.select(event_id(F.col("EventTemplate")).alias("EventId"), "EventTemplate", "Occurrences")


def mined_template_counts(mining: Mining) -> DataFrame:
    """D6 from the mining result alone: clusters of equal template text are one event, and no line is read."""
    sizes = mining.members.groupBy("ClusterId").agg(F.sum("n").alias("n"))
    labels = mining.clusters.select("ClusterId", "EventId", "EventTemplate")
    return sizes.join(labels, "ClusterId").groupBy("EventId", "EventTemplate").agg(F.sum("n").alias("Occurrences"))
