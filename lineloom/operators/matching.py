"""Best known template for each message (D9), and the pair scoring that mining shares with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lineloom.functions.similarity import (
    native_similarity, needs_ngrams, ngram_bound, ngram_hashes, ngram_similarity,
)
from lineloom.operators.candidates import indexed_join, use_index
from lineloom.operators.messages import signature_table, with_tokens
from lineloom.plans.joins import compare_join, hot_keys, spread_join
from lineloom.workspace import Workspace


def similar_pairs(
    many: DataFrame, few: DataFrame, method: str, st: float, n: int, extra: Column | None = None, spread: str = "First",
    ws: Workspace | None = None,
) -> DataFrame:
    """``(many.*, ClusterId, Known, Score)`` for all pairs of a bucket that reach ``st``; ``extra`` compares ``few.ClusterId`` and ``many.First``.

    Buckets with many templates are searched through an index of rare tokens, others pair by pair.
    ``few`` has ``Bucket, ClusterId, Tokens``; tables that the result reads go to ``ws``.  What the JVM can compute is computed there; an n-gram ratio is asked for
    only where its upper bound reaches ``st`` and exceeds the other measures, since elsewhere it changes nothing.
    """
    indexed = use_index(few, method, st)
    many, few, reach = comparison(many, few, method, st, n)
    t, m = F.col("few.Known"), F.col("many.Tokens")
    condition = F.when(F.size(t) == 0, F.size(m) == 0).otherwise(reach)
    if indexed:
        ws = ws or Workspace(many.sparkSession)
        return score_pairs(indexed_join(many, few, method, st, condition, extra, ws), method, st, n)
    if extra is not None:
        condition = extra & condition  # the cheap part first
    return score_pairs(compare_join(many, few, "Bucket", condition, "inner", spread, "Known"), method, st, n)


def comparison(
    many: DataFrame, few: DataFrame, method: str, st: float, n: int
) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with the helper columns of ``method`` (``Tokens`` of ``few`` becomes ``Known``), and the condition
    that every pair at ``st`` or above meets; for methods without n-grams it holds for no other pair."""
    few = few.withColumnRenamed("Tokens", "Known")
    t, m = F.col("few.Known"), F.col("many.Tokens")
    reach = native_similarity(method, t, m) >= st
    if needs_ngrams(method):
        many = many.withColumn("Grams", ngram_hashes(F.col("Tokens"), n))
        few = few.withColumn("KnownGrams", ngram_hashes(F.col("Known"), n))
        reach = reach | (ngram_bound(F.col("few.KnownGrams"), F.col("many.Grams")) >= st)
    return many, few, reach


def score_pairs(pairs: DataFrame, method: str, st: float, n: int) -> DataFrame:
    t, m = F.col("Known"), F.col("Tokens")
    score = F.when(F.size(t) == 0, F.lit(1.0)).otherwise(native_similarity(method, t, m))
    pairs = pairs.withColumn("Score", score)
    if needs_ngrams(method):
        pairs = pairs.withColumn("Bound", ngram_bound(F.col("KnownGrams"), F.col("Grams")))
        ask = (F.col("Bound") >= st) & (F.col("Bound") > F.col("Score"))
        ratio = F.coalesce(ngram_similarity(F.when(ask, t), F.when(ask, m), n), F.lit(0.0))
        pairs = pairs.withColumn("Ratio", ratio).withColumn("Score", F.greatest("Score", "Ratio")).drop(
            "Ratio", "Bound"
        ).where(F.col("Score") >= st)
    # without n-grams the join condition was exact; a filter here would be pushed in front of its cheap parts
    return pairs.drop("Grams", "KnownGrams")


def best_match(sigs: DataFrame, known: DataFrame, method: str, st: float, n: int) -> DataFrame:
    """``(First, ClusterId, Score)``: highest similarity, the oldest cluster on ties.  Unmatched rows are absent."""
    return best_pairs(similar_pairs(sigs.select("Bucket", "First", "Tokens"), known, method, st, n))


def best_pairs(pairs: DataFrame, score: str = "Score") -> DataFrame:
    """Per ``First`` the pair with the highest score, and of those the smallest ``ClusterId``.

    Two steps over plain numbers stay hash aggregates; a maximum over a struct would sort all pairs.
    """
    oldest = pairs.groupBy("First", score).agg(F.min("ClusterId").alias("ClusterId"))
    return oldest.groupBy("First").agg(F.max_by("ClusterId", score).alias("ClusterId"), F.max(score).alias(score))


def match_templates(
    lines: DataFrame, templates: DataFrame, st: float, method: str = "seqDist", n: int = 3
) -> DataFrame:
    """``lines`` (``LineId, Bucket, Signature``) with ``ClusterId`` and ``Score``, NULL where nothing reaches ``st``.

    ``templates`` has ``Bucket, ClusterId, Tokens``; a smaller ``ClusterId`` is older.  Distinct signatures are
    compared, not lines.
    """
    ws = Workspace(lines.sparkSession)
    sigs = ws.table(with_tokens(signature_table(lines)), "signatures", "First")
    best = best_match(sigs, templates, method, st, n)
    table = ws.table(sigs.join(best, "First", "left").select("Signature", "n", "ClusterId", "Score"), "matches")
    hot = hot_keys(table, ["Signature"], "n")
    return spread_join(lines, table.drop("n"), ["Signature"], hot, "LineId")
