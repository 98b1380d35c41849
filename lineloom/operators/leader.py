"""Template mining by leaders (D3): the scalable mode.

Distinct signatures are scanned in order of their first line; one that is similar to an earlier leader of its bucket
joins it, any other becomes a leader.  The rounds of ``earliest`` give exactly that result without a sequential scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from lineloom.functions.masking import SEP, WILDCARD, marked_to_tokens
from lineloom.operators.earliest import find_earliest
from lineloom.operators.matching import best_pairs, similar_pairs
from lineloom.operators.messages import with_tokens
from lineloom.operators.positional import differing_places, positional_pairs, task_groups
from lineloom.plans.joins import hot_keys, spread_join
from lineloom.workspace import Workspace

# Fixed value: a token that starts like this is a delimiter and outlives a mismatch.
DELIMITER_START = r"^(\s|[|\[\]{}()])"


def find_leaders(sigs: DataFrame, method: str, st: float, n: int, ws: Workspace) -> DataFrame:
    """``(Bucket, ClusterId, Signature)`` of all leaders; ``ClusterId`` is the leader's first line."""
    scratch = Workspace(ws.spark)

    def reach(rows: DataFrame, leaders: DataFrame) -> DataFrame:
        scratch.close()  # what the call before left has been read
        return _earlier_pairs(rows, leaders, method, st, n, scratch)

    leaders = find_earliest(sigs.select("Bucket", "First", "Signature"), reach, ws)
    scratch.close()
    return leaders


def _earlier_pairs(rows: DataFrame, leaders: DataFrame, method: str, st: float, n: int, ws: Workspace) -> DataFrame:
    ids = (rows.schema["First"].dataType, leaders.schema["ClusterId"].dataType)
    if method == "seqDist" and ids == (LongType(), LongType()) and (groups := task_groups(leaders, st)):
        return positional_pairs(rows.where(F.col("First").isNotNull()), leaders.where(F.col("ClusterId").isNotNull()), groups, st, earlier=True)
    many, few = with_tokens(rows).drop("Signature"), with_tokens(leaders).drop("Signature")
    return similar_pairs(many, few, method, st, n, extra=F.col("few.ClusterId") < F.col("many.First"), ws=ws)


def choose_leader(sigs: DataFrame, leaders: DataFrame, method: str, st: float, n: int, ws: Workspace) -> DataFrame:
    """``(First, ClusterId)``: the most similar earlier leader, the oldest on ties; a leader keeps itself."""
    others = sigs.join(leaders.select(F.col("ClusterId").alias("First")), "First", "left_anti")
    pairs = _earlier_pairs(others.select("Bucket", "First", "Signature"), leaders, method, st, n, ws)
    own = leaders.select(F.col("ClusterId").alias("First"), "ClusterId")
    return best_pairs(pairs).select("First", "ClusterId").unionByName(own)


def _outlives(token: Column, delimiters: bool) -> Column:
    return token.rlike("(?U)" + DELIMITER_START) if delimiters else F.lit(False)


def merged_tokens(message: Column, template: Column, delimiters: bool = True) -> Column:
    """D4 for one pair: equal tokens stay, a mismatch is a wildcard unless the newer token is a delimiter."""
    return F.zip_with(
        message,
        template,
        lambda new, old: F.when((new == old) | _outlives(new, delimiters), new).otherwise(WILDCARD),
    )


def merge_template(members: DataFrame, delimiters: bool = True) -> DataFrame:
    """D4 for whole clusters: ``(Bucket, ClusterId, Tokens, Last, n)`` from ``First, ClusterId, Tokens, Last, n`` (or ``Signature`` for ``Tokens``).

    The pairwise rule folded over all messages of a cluster depends only on two things: at which positions any
    message differs from the leader, and the newest message.  Only differing positions are exploded, and all
    aggregates are over integers.  Messages travel as marked strings, a third of their tokens.
    """
    if "Tokens" in members.columns:
        members = members.withColumn("Signature", F.array_join("Tokens", SEP)).drop("Tokens")
    leaders = members.where(F.col("First") == F.col("ClusterId")).select(
        "Bucket", "ClusterId", F.col("Signature").alias("Lead")
    )
    newest = members.groupBy("ClusterId").agg(
        F.max_by("First", "Last").alias("Newest"), F.max("Last").alias("Last"), F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("size"),
    )
    followers = members.where(F.col("First") != F.col("ClusterId")).select("First", "ClusterId", "Signature")
    hot = hot_keys(newest, ["ClusterId"], "size", 10_000)
    varying = (
        differing_places(spread_join(followers, leaders.drop("Bucket"), ["ClusterId"], hot, "First"))
        .distinct()
        .groupBy("ClusterId").agg(F.collect_list("Pos").alias("Varying"))
    )
    newest_tokens = members.select(F.col("First").alias("Newest"), F.col("Signature").alias("Fresh"))
    rows = (
        leaders.join(newest, "ClusterId").join(newest_tokens, "Newest").join(varying, "ClusterId", "left")
        .withColumn("Varying", F.coalesce("Varying", F.array().cast("array<int>")))
        .withColumn("Fresh", marked_to_tokens(F.col("Fresh")))
    )
    tokens = F.transform(
        "Fresh",
        lambda token, i: F.when(~F.array_contains("Varying", i), token)
        .when(_outlives(token, delimiters), token)
        .otherwise(WILDCARD),
    )
    return rows.select("Bucket", "ClusterId", tokens.alias("Tokens"), "Last", "n")


def mine_leaders(
    sigs: DataFrame,
    method: str,
    st: float,
    n: int,
    ws: Workspace,
    refine: bool = False,
    delimiters: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(First, Signature, n, ClusterId; clusters)`` for a written signature table, which nothing has to read afterwards."""
    leaders = find_leaders(sigs, method, st, n, ws)
    scratch = Workspace(ws.spark)
    choice = choose_leader(sigs, leaders, method, st, n, scratch)
    members = ws.table(
        sigs.select("Bucket", "First", "Last", "n", "Signature").join(choice, "First"), "members", "First", codec="zstd"
    )
    scratch.close()
    ws.drop(leaders)
    ws.sweep()
    clusters = merge_template(members, delimiters)
    mapping = members.select("First", "Signature", "n", "ClusterId")
    if refine:
        as_sigs = clusters.withColumnRenamed("ClusterId", "First").withColumn("Signature", F.array_join("Tokens", SEP))
        again, clusters = mine_leaders(ws.table(as_sigs.drop("Tokens"), "templates"), method, st, n, ws, delimiters=delimiters)
        again = again.select(F.col("First").alias("ClusterId"), F.col("ClusterId").alias("Final"))
        mapping = mapping.join(again, "ClusterId").select("First", "Signature", "n", F.col("Final").alias("ClusterId"))
    return mapping, clusters
