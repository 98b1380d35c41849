"""Frequent-word mining (H1): a message is described by its words that are frequent at their position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lineloom.functions.masking import SEP, WILDCARD, marked_length
from lineloom.operators.frequent import chunk_labels, describe, frequent_numbers
from lineloom.operators.mining import Mining, label_clusters
from lineloom.operators.words import word_lines
from lineloom.plans.joins import compare_join, hot_keys, spread_join
from lineloom.workspace import Workspace


def mine_slct(
    messages: DataFrame, support: int, combine: bool = False, masks: Sequence[str] = ()
) -> Mining:
    """H1.  Templates describe more than ``support`` lines; other lines are outliers and have no cluster.

    Words count over distinct messages weighted by their number of lines.  ``combine`` joins a template to the most
    general one that covers it.
    """
    ws = Workspace(messages.sparkSession)
    sigs = word_lines(messages, masks).groupBy("Signature").agg(F.count(F.lit(1)).alias("n"), F.min("LineId").alias("First"))
    sigs = sigs.select("Signature", "n", "First", F.xxhash64("Signature").alias("Hash"), marked_length(F.col("Signature")).alias("Size"))
    sigs = ws.table(sigs.withColumn("Chunk", chunk_labels(F.col("Size"))), "distinct-messages", codec="zstd")
    ws.sweep()
    frequent = ws.table(frequent_numbers(sigs, support), "frequent-words")
    ws.sweep()
    described = ws.table(describe(sigs, frequent), "described")
    ws.sweep()
    scratch = Workspace(ws.spark)
    candidates = ws.table(_candidates(sigs, described, support, scratch), "candidates")
    scratch.close()
    ws.sweep()
    members = spread_join(
        described.select("First", "Hash", "n", "Digest"), candidates.select("Digest", "ClusterId"), ["Digest"],
        hot_keys(candidates, ["Digest"], "Cells"), "Hash",
    )
    # the hash alone could collide
    members = sigs.select("First", "Hash", "Signature").join(members, ["First", "Hash"]).select("Signature", "n", "ClusterId")
    clusters = candidates.select("Bucket", "ClusterId", "Tokens")
    if combine:
        target = ws.table(_most_general(candidates), "combined")
        members = members.join(target, "ClusterId").select("Signature", "n", F.col("Into").alias("ClusterId"))
        clusters = clusters.join(target.where(F.col("ClusterId") == F.col("Into")), "ClusterId").drop("Into")
    return Mining(members, ws.table(label_clusters(clusters, " "), "rendered"), "Signature")


def _candidates(sigs: DataFrame, described: DataFrame, support: int, ws: Workspace) -> DataFrame:
    """``Bucket, ClusterId, n, Cells, Digest, Tokens`` of every description of more than ``support`` lines; one of its messages lends the words."""
    large = ws.table(
        described.groupBy("Digest").agg(
            F.sum("n").alias("n"), F.min("First").alias("ClusterId"), F.count(F.lit(1)).alias("Cells"), F.min("Hash").alias("Hash")
        ).where(F.col("n") > support),
        "large",
    )
    lenders = ws.table(described.select("Digest", "Hash", "First", "Size", "Keep").join(large, ["Digest", "Hash"]), "lenders").alias("l")
    texts = sigs.select("Hash", "First", "Signature").alias("s")
    same = (F.col("l.Hash") == F.col("s.Hash")) & F.col("l.First").eqNullSafe(F.col("s.First"))
    words = F.zip_with(F.split("Signature", SEP), "Keep", lambda word, keep: F.when(keep, word).otherwise(WILDCARD))
    return lenders.join(texts, same).select(F.col("Size").cast("string").alias("Bucket"), "ClusterId", "n", "Cells", "Digest", words.alias("Tokens"))


def _most_general(candidates: DataFrame) -> DataFrame:
    """``ClusterId, Into``: the covering template with fewest constants (then most lines, then the oldest)."""
    mine = candidates.select("Bucket", F.col("ClusterId").alias("First"), "Tokens")
    others = candidates.select("Bucket", "ClusterId", "n", F.col("Tokens").alias("General")).withColumn(
        "Constants", F.size(F.filter("General", lambda t: t != WILDCARD))
    )
    covers = F.forall(
        F.zip_with("few.General", "many.Tokens", lambda g, t: (g == WILDCARD) | (g == t)), lambda ok: ok
    )
    pairs = compare_join(mine, others, "Bucket", covers, text="General")
    rank = F.struct("Constants", (-F.col("n")).alias("Size"), "ClusterId")
    return pairs.groupBy("First").agg(F.min(rank).alias("Best")).select(
        F.col("First").alias("ClusterId"), F.col("Best.ClusterId").alias("Into")
    )


def slct_outliers(messages: DataFrame, mining: Mining, masks: Sequence[str] = ()) -> DataFrame:
    """Lines whose description is not frequent enough.  They meet the members by a digest of 32 bytes, not by their text."""
    digest = F.unhex(F.sha2("Signature", 256)).alias("Digest")
    lines = word_lines(messages, masks).select("LineId", digest)
    return lines.join(mining.members.select(digest), "Digest", "left_anti").select("LineId")
