"""Leaders of an ordered set: a row leads unless an earlier leader reaches it.

A scan in line order is a greedy independent set, and any prefix of that order can be settled as soon as the rows that earlier leaders reach are
gone.  So each round takes a prefix of every bucket, joins its rows among themselves, settles them by passes over id pairs, and compares the new
leaders with everything behind the prefix at once.  The prefixes double while they are sparse: the more leaders are known, the fewer of
the following rows are similar to each other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from lineloom.workspace import Workspace

FIRST_HEADS = 64
#: Prefixes with more similar pairs a row than these are followed by shorter ones, so that pairs stay linear in rows.
DENSE = 64
# Up to this many rows a bucket Spark limits a ranking before its shuffle.
_RANKED = 1000

#: ``(rows, leaders) -> First, ClusterId`` of every pair in which an earlier leader reaches a row
Reach = Callable[[DataFrame, DataFrame], DataFrame]


def earliest_rows(pool: DataFrame, heads: int) -> DataFrame:
    """``First`` of about ``heads`` earliest rows of every bucket: always a prefix, never empty."""
    if heads <= _RANKED:
        order = Window.partitionBy("Bucket").orderBy("First")
        return pool.select("Bucket", "First").withColumn("place", F.row_number().over(order)).where(F.col("place") <= heads).select("First")
    # a ranking would sort a bucket in one task; quantiles combine before the shuffle
    largest = pool.groupBy("Bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    quantile = F.percentile_approx("First", min(1.0, heads / largest), 100_000)
    cut = F.when(F.count(F.lit(1)) <= heads, F.max("First")).otherwise(quantile)
    cuts = pool.groupBy("Bucket").agg(cut.alias("Cut"))
    return pool.select("Bucket", "First").join(cuts, "Bucket").where(F.col("First") <= F.col("Cut")).select("First")


def independent(rows: DataFrame, edges: DataFrame, ws: Workspace) -> DataFrame:
    """``First`` of the rows that no chosen earlier row reaches; ``edges`` has ``First, ClusterId`` with ``ClusterId < First``.

    In a pass every row with outgoing and no incoming edges leads, and what it reaches goes with all edges of its own.
    """
    gone: list[DataFrame] = []
    while not edges.isEmpty():
        leads = edges.select("ClusterId").distinct().join(edges.select(F.col("First").alias("ClusterId")), "ClusterId", "left_anti")
        reached = ws.table(edges.join(leads, "ClusterId", "left_semi").select("First").distinct(), "reached")
        gone.append(reached)
        edges = ws.table(
            edges.join(reached, "First", "left_anti").join(reached.select(F.col("First").alias("ClusterId")), "ClusterId", "left_anti"), "edges"
        )
    return rows.join(reduce(DataFrame.unionByName, gone), "First", "left_anti") if gone else rows


def find_earliest(pool: DataFrame, reach: Reach, ws: Workspace, heads: int | None = None) -> DataFrame:
    """``Bucket, ClusterId`` and the text column of all leaders of ``pool`` (``Bucket, First`` and ``Tokens`` or ``Signature``);
    ``ClusterId`` is the leader's first line.

    What ``reach`` returns is written before it is called again.  A round's tables go with the round; only leaders and undecided rows stay.
    """
    found: list[DataFrame] = []
    heads = heads or FIRST_HEADS
    text = [c for c in pool.columns if c not in ("Bucket", "First")]
    undecided = None
    while True:
        step = Workspace(ws.spark)
        ids = step.table(earliest_rows(pool, heads), "ids")
        earliest = step.table(pool.join(ids, "First", "left_semi").select("Bucket", "First", *text), "heads", "First")
        as_leaders = earliest.withColumnRenamed("First", "ClusterId")
        edges = step.table(reach(earliest, as_leaders).select("First", "ClusterId"), "edges")
        dense = edges.count() > DENSE * earliest.count()
        chosen = independent(earliest.select("First"), edges, step)
        fresh = ws.table(
            as_leaders.join(chosen.withColumnRenamed("First", "ClusterId"), "ClusterId", "left_semi").select("Bucket", "ClusterId", *text),
            "leaders",
        )
        found.append(fresh)
        rest = pool.join(ids, "First", "left_anti")
        if not rest.isEmpty():
            hits = step.table(reach(rest, fresh).select("First").distinct(), "hits")
            rest = ws.table(rest.join(hits, "First", "left_anti"), "undecided", "First")
            done = rest.isEmpty()
        else:
            done = True
        if undecided is not None:
            ws.drop(undecided)
        step.close()
        ws.sweep()
        if done:
            if len(found) == 1:
                return fresh
            leaders = ws.table(reduce(DataFrame.unionByName, found), "all-leaders")
            for table in found:
                ws.drop(table)
            return leaders
        pool = undecided = rest
        heads = max(FIRST_HEADS, heads // 2) if dense else 2 * heads
