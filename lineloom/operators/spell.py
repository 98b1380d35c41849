"""Longest-common-subsequence mining (H4): a message joins the leader it shares the longest sequence with."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lineloom.functions.masking import WILDCARD
from lineloom.operators.candidates import prefixes
from lineloom.operators.earliest import find_earliest
from lineloom.operators.matching import best_pairs
from lineloom.operators.mining import Mining, label_clusters
from lineloom.operators.words import distinct_messages, word_lines
from lineloom.plans.joins import hot_keys, spread_join
from lineloom.workspace import Workspace


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, one machine-integer row at a time."""
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def alignment(lead: Sequence[str], weights: Sequence[int], message: Sequence[str]) -> list[int]:
    """What the message changes in the leader: ``i`` for a leader token it lacks, ``-1 - i`` for extra tokens of its
    own before leader token ``i``.

    Among longest common subsequences, the one with the largest sum of ``weights`` is taken.
    """
    a, b = len(lead), len(message)
    unit = sum(weights) + 1
    best = [[0] * (b + 1) for _ in range(a + 1)]
    for i in range(a - 1, -1, -1):
        for j in range(b - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1])
            if lead[i] == message[j]:
                best[i][j] = max(best[i][j], best[i + 1][j + 1] + unit + weights[i])
    marks, i, j = [], 0, 0
    while i < a or j < b:
        hit = i < a and j < b and lead[i] == message[j]
        if hit and best[i][j] == best[i + 1][j + 1] + unit + weights[i]:
            i, j = i + 1, j + 1
        elif i < a and (j == b or best[i + 1][j] >= best[i][j + 1]):
            marks.append(i)
            i += 1
        else:
            if -1 - i not in marks[-1:]:
                marks.append(-1 - i)
            j += 1
    return marks


@F.pandas_udf(IntegerType())
def _shared(lead: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(a), list(b)) for a, b in zip(lead, tokens)], dtype="int32")


@F.pandas_udf(ArrayType(IntegerType()))
def _marks(lead: pd.Series, weights: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series(
        [alignment(list(a), [int(x) for x in w], list(b)) for a, w, b in zip(lead, weights, tokens)]
    )


def _occurrences(df: DataFrame, key: str, tau: float) -> DataFrame:
    """``key, Prefix, Size, Item``: a partner holds ``tau`` of a message's words, so it holds one of the first ``Prefix`` rarest."""
    need = F.greatest(F.ceil(F.size("Tokens") * F.lit(tau) - 1e-9), F.lit(1))
    rows = df.select(key, (F.size("Tokens") - need + 1).cast("int").alias("Prefix"), F.size("Tokens").alias("Size"), "Tokens")
    return rows.where("Prefix > 0").select(key, "Prefix", "Size", F.explode(F.transform("Tokens", lambda t: F.xxhash64(t))).alias("Item"))


def _pairs(many: DataFrame, leaders: DataFrame, tau: float, ws: Workspace) -> DataFrame:
    """Pairs with a common subsequence of at least ``tau`` of the message, found by the rare words of the message.

    Common words bound the subsequence from above; only what they leave is aligned.
    """
    words = leaders.select("ClusterId", F.explode(F.array_distinct(F.transform("Tokens", lambda t: F.xxhash64(t)))).alias("Item"))
    words = ws.table(words, "leader-words")
    holders = ws.table(words.groupBy("Item").agg(F.count(F.lit(1)).alias("Holders")), "holders")
    asked = ws.table(prefixes(_occurrences(many, "First", tau).join(holders, "Item"), "First").distinct(), "asked")
    hot = hot_keys(asked.groupBy("Item").agg(F.count(F.lit(1)).alias("rows")), ["Item"], "rows", 10_000)
    met = spread_join(asked, words, ["Item"], hot, "First", condition=F.col("few.ClusterId") < F.col("many.First"))
    met = ws.table(met.select("First", "ClusterId").distinct(), "candidates", "First")
    lead = leaders.select("ClusterId", F.col("Tokens").alias("Lead"))
    pairs = many.select("First", "Tokens").join(met, "First").join(lead, "ClusterId")
    common = F.size(F.filter("Tokens", lambda t: F.array_contains("Lead", t)))
    pairs = pairs.where((common >= F.size("Tokens") * tau) & (common > 0))
    return pairs.withColumn("Shared", _shared("Lead", "Tokens")).where(
        (F.col("Shared") >= F.size("Tokens") * tau) & (F.col("Shared") > 0)
    )


def _leaders(sigs: DataFrame, tau: float, ws: Workspace) -> DataFrame:
    def reach(rows: DataFrame, leaders: DataFrame) -> DataFrame:
        return _pairs(rows, leaders, tau, ws)

    return find_earliest(sigs.select(F.lit("").alias("Bucket"), "First", "Tokens"), reach, ws)


def mine_spell(messages: DataFrame, tau: float = 0.5, masks: Sequence[str] = ()) -> Mining:
    """H4.  A template is the part of the leader that all members share, with a wildcard wherever one departs."""
    ws = Workspace(messages.sparkSession)
    sigs = distinct_messages(ws.table(word_lines(messages, masks), "lines"), ws)
    leaders = _leaders(sigs, tau, ws)
    own = leaders.select(F.col("ClusterId").alias("First"), "ClusterId")
    others = sigs.select("First", "Tokens").join(own.select("First"), "First", "left_anti")
    best = best_pairs(_pairs(others, leaders, tau, ws), "Shared")
    choice = best.select("First", "ClusterId").unionByName(own)
    members = ws.table(sigs.select("First", "n", "Signature", "Tokens").join(choice, "First"), "members", "First")

    hot = hot_keys(members.groupBy("ClusterId").agg(F.count(F.lit(1)).alias("rows")), ["ClusterId"], "rows", 10_000)
    lead = leaders.select("ClusterId", F.col("Tokens").alias("Lead"))
    followers = members.where(F.col("First") != F.col("ClusterId")).select("First", "ClusterId", "Tokens")
    # how many followers hold each leader word: where two alignments are equally long, the common words win
    held = F.posexplode(F.transform("Lead", lambda t: F.array_contains("Tokens", t))).alias("Pos", "Held")
    support = (
        spread_join(followers, lead, ["ClusterId"], hot, "First").select("ClusterId", held).where("Held")
        .groupBy("ClusterId", "Pos").agg(F.count(F.lit(1)).alias("Followers"))
        .groupBy("ClusterId").agg(F.map_from_entries(F.collect_list(F.struct("Pos", "Followers"))).alias("Support"))
    )
    weights = F.transform("Lead", lambda t, i: F.coalesce(F.try_element_at("Support", i), F.lit(0).cast("bigint")))
    weighed = ws.table(
        lead.join(support, "ClusterId", "left").select("ClusterId", "Lead", weights.alias("Weights")), "weighed"
    )
    followers = spread_join(followers, weighed, ["ClusterId"], hot, "First")
    marks = (
        followers.select("ClusterId", F.explode(_marks("Lead", "Weights", "Tokens")).alias("Mark")).distinct()
        .groupBy("ClusterId").agg(F.collect_list("Mark").alias("Marks"))
    )
    marked = lead.join(marks, "ClusterId", "left").withColumn(
        "Marks", F.coalesce("Marks", F.array().cast("array<int>"))
    )
    nothing = F.array().cast("array<string>")

    def gap(i):
        return F.when(F.array_contains("Marks", -1 - i), F.array(F.lit(WILDCARD))).otherwise(nothing)

    pieces = F.flatten(
        F.transform(
            "Lead",
            lambda t, i: F.concat(gap(i), F.array(F.when(F.array_contains("Marks", i), WILDCARD).otherwise(t))),
        )
    )
    clusters = marked.select("ClusterId", F.concat(pieces, gap(F.size("Lead"))).alias("Raw"))
    tokens = F.filter(
        "Raw", lambda t, i: ~((t == WILDCARD) & (F.coalesce(F.get("Raw", i - 1), F.lit("")) == WILDCARD))
    )
    clusters = clusters.select(F.lit("").alias("Bucket"), "ClusterId", tokens.alias("Tokens"))
    return Mining(
        members.select("Signature", "n", "ClusterId"), ws.table(label_clusters(clusters, " "), "rendered"), "Signature"
    )
