"""A mix of sources that meets a target for each, drawn as blocks and dealt to output shards.

The documents of a source, in the order of a seeded hash, make one long line of words; the mix takes as many words from its
start as the target says, and goes round again beyond its end.  The line is cut into blocks of about ``block_words``
words by ranges of the hash.  A source's *quota* is the number of block draws its target needs.

A multivariate-hypergeometric tree splits the quotas: the shards are halved again and again, and at each node one draw
decides how many blocks of every source go to the left half.  Each leaf thus gets an exact count for every
source, and a disjoint range of the source's permuted draws.  A task walks from the root to its own leaves with seeded random
numbers for every node, so no table of shards passes through the driver and reruns agree.  Inside a shard the drawn
documents are put in random order.

Only one row for each *source* is gathered on the driver; documents and blocks stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lineloom.llm.rows import WORD, row_key
from lineloom.workspace import Workspace

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 1 << 18
SHARD_BLOCKS = 64
SEED = 7


def source_targets(
    totals: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> dict[str | None, float]:
    """Words each source should give: shares by weight, none above ``most`` times its size, the excess dealt again.

    Sources are ordered by code point, a missing name last, and take the weights in turn.
    """
    names = sorted((n for n in totals if n is not None)) + ([None] if None in totals else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left = share * sum(totals.values())
    open_ = [n for n in names if totals[n] > 0]
    targets = {n: 0.0 for n in names}
    while open_:
        unit = left / sum(weight[n] for n in open_)
        full = [n for n in open_ if unit * weight[n] > most * totals[n]]
        for n in full or open_:
            targets[n] = most * totals[n] if full else unit * weight[n]
        if not full:
            break
        left -= sum(targets[n] for n in full)
        open_ = [n for n in open_ if n not in set(full)]
    return targets


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size`` and the place ``u`` in the source's line, from 0 to below 1."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), row_key(), F.col("doc_id")), 11).cast("double") / float(1 << 53)
    return docs.select("doc_id", "source", size.alias("size"), place.alias("u"), row_key().alias("row_key"))


def _leaf_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of every source for one shard, and where its range begins in each source's draws."""
    low, high, node = 0, shards, 1
    own, start = quotas.copy(), np.zeros(len(quotas), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        total = int(own.sum())
        wanted = total * (middle - low) // (high - low)
        draw = np.random.default_rng([seed, node])
        left = np.zeros(len(own), np.int64)
        rest, need = total, wanted
        for i, count in enumerate(own):
            if not need:
                break
            left[i] = draw.hypergeometric(int(count), rest - int(count), need) if count else 0
            rest, need = rest - int(count), need - int(left[i])
        if shard < middle:
            own, high, node = left, middle, 2 * node
        else:
            own, start, low, node = own - left, start + left, middle, 2 * node + 1
    return own, start


def _shard_rows(numbers: list[int], quotas: list[int], shards: int, seed: int):
    counts = np.array(quotas, np.int64)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                own, start = _leaf_quotas(counts, shards, int(shard), seed)
                kept = np.flatnonzero(own)
                yield pd.DataFrame({
                    "source_no": np.array(numbers, np.int64)[kept], "shard": int(shard), "first": start[kept],
                    "draws": own[kept],
                })

    return run


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = SEED,
    workspace: Workspace | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The documents with their shares, and the draws.

    The first result has one row for each row of ``docs``: ``doc_id, row_key, source, size, source_size, target, source_no, block,
    u, rounds, taken``: it is taken whole ``rounds`` times, ``taken`` words in all; at most one document of a source gives a part
    of itself.  The second has ``source_no, block, round, shard``: which shard takes the block in that round.

    A null or empty text has size 0 and gives nothing; a source without words has the target 0.  Rows of one id are
    separate documents, equal rows stand beside each other in the line.
    """
    spark = docs.sparkSession
    workspace = workspace or Workspace(spark)
    line = workspace.table(sized(docs, seed), "sized")
    totals = {r["source"]: r["words"] for r in line.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    targets = source_targets(totals, weights, share, most)
    names = list(targets)
    blocks = [max(1, -(-totals[n] // block_words)) for n in names]
    plan = []
    for i, n in enumerate(names):
        words = int(round(targets[n]))
        rounds = words // totals[n] if totals[n] else 0
        plan.append((n, i, totals[n], float(targets[n]), blocks[i], rounds, words - rounds * totals[n]))
    recipe = spark.createDataFrame(
        plan, "its string, source_no bigint, source_size bigint, target double, blocks bigint, rounds bigint, part bigint"
    )
    recipe = F.broadcast(recipe)  # a row for each source
    line = line.join(recipe, F.col("source").eqNullSafe(F.col("its"))).withColumn(
        "block", F.floor(F.col("u") * F.col("blocks"))
    )
    # words before each block, by groups of blocks first: no window spans a whole source
    sums = line.groupBy("source_no", "block").agg(F.sum("size").alias("words")).withColumn("group", F.col("block") / 1024)
    sums = workspace.table(sums.withColumn("group", F.floor("group")), "blocks")
    groups = sums.groupBy("source_no", "group").agg(F.sum("words").alias("group_words"))
    before = Window.partitionBy("source_no").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("group_start", F.coalesce(F.sum("group_words").over(before), F.lit(0)))
    inside = Window.partitionBy("source_no", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("in_group", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(
        groups, ["source_no", "group"]
    ).select("source_no", "block", "words", (F.col("group_start") + F.col("in_group")).alias("start"))
    placed = workspace.table(placed, "block-starts")
    line = line.join(placed, ["source_no", "block"]).drop("its")
    # the block in which the last round ends is the only one where single documents have to be placed
    ends_here = (F.col("start") < F.col("part")) & (F.col("start") + F.col("words") > F.col("part"))
    in_block = Window.partitionBy("source_no", "block").orderBy("u", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    cut = line.where(ends_here).withColumn(
        "at", F.col("start") + F.coalesce(F.sum("size").over(in_block), F.lit(0))
    ).withColumn("last", F.least(F.col("size"), F.greatest(F.lit(0), F.col("part") - F.col("at")))).drop("at")
    whole = line.where(~ends_here).withColumn(
        "last", F.when(F.col("start") < F.col("part"), F.col("size")).otherwise(F.lit(0))
    )
    shares = cut.unionByName(whole)
    shares = shares.withColumn("taken", (F.col("rounds") * F.col("size") + F.col("last")).cast("bigint"))
    shares = shares.select(
        "doc_id", "row_key", "source", "size", "source_size", "target", "source_no", "block", "u", "rounds", "taken"
    )

    # draws: every block with words in each full round, and in the last round those that begin before its end
    times = F.col("rounds") + F.when(F.col("start") < F.col("part"), 1).otherwise(0)
    drawn = placed.where(F.col("words") > 0).join(recipe, "source_no").withColumn("times", times)
    # sequence(0, -1) counts down, so blocks that no round takes have to go before it
    rounds = drawn.where(F.col("times") > 0).select(
        "source_no", "block", F.explode(F.expr("sequence(0L, times - 1)")).alias("round")
    )
    rounds = workspace.table(rounds, "draws")
    quota = {r["source_no"]: r["n"] for r in rounds.groupBy("source_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    numbers = sorted(quota)
    shards = max(1, -(-sum(quota.values()) // shard_blocks))
    ranges = spark.range(shards).mapInPandas(
        _shard_rows(numbers, [quota[n] for n in numbers], shards, seed),
        "source_no bigint, shard bigint, first bigint, draws bigint",
    )
    seats = ranges.select(
        "source_no", "shard", F.explode(F.expr("sequence(first, first + draws - 1)")).alias("seat")
    )
    # blocks are ranges of a hash, so their number is a permutation; rounds follow one another
    order = recipe.join(
        rounds.groupBy("source_no", "round").agg(F.count(F.lit(1)).alias("held")), "source_no"
    ).select("source_no", "round", "held")
    ahead = Window.partitionBy("source_no").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    order = order.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0))).drop("held")
    rank = Window.partitionBy("source_no", "round", "group").orderBy("block")
    grouped = rounds.withColumn("group", F.floor(F.col("block") / 1024))
    per_group = grouped.groupBy("source_no", "round", "group").agg(F.count(F.lit(1)).alias("held"))
    ahead_group = Window.partitionBy("source_no", "round").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    per_group = per_group.withColumn("group_ahead", F.coalesce(F.sum("held").over(ahead_group), F.lit(0))).drop("held")
    seated = (
        grouped.withColumn("rank", F.row_number().over(rank) - 1)
        .join(per_group, ["source_no", "round", "group"]).join(order, ["source_no", "round"])
        .withColumn("seat", F.col("ahead") + F.col("group_ahead") + F.col("rank"))
    )
    draws = seated.join(seats, ["source_no", "seat"]).select("source_no", "block", "round", "shard")
    return shares, workspace.table(draws, "shards")


def mix_report(shares: DataFrame, draws: DataFrame) -> DataFrame:
    """One row for each document; ``shards`` lists where it goes, a shard twice if it takes both rounds."""
    dealt = draws.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("round", "shard"))).alias("dealt"))
    out = shares.join(dealt, ["source_no", "block"], "left")
    # a block drawn in the last round holds documents beyond the cut, which that round does not take
    drawn = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.col("rounds")).cast("int")
    seats = F.slice(F.coalesce("dealt", F.array().cast("array<struct<round:bigint,shard:bigint>>")), F.lit(1), drawn)
    return out.select(
        "doc_id", "size", "source_size", "target", "taken", F.transform(seats, lambda s: s["shard"]).alias("shards")
    )


def mixed_documents(docs: DataFrame, shares: DataFrame, draws: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: a row ``shard, place, words, row`` for each time a document is taken.

    ``words`` says how many of its words, from the first on, the round takes; ``place`` is a random order inside the shard.
    """
    # rows that repeat id, source and text are numbered on both sides, so each meets one share
    again = Window.partitionBy("its_id", "its_key", "its_source").orderBy("taken")
    numbered = shares.withColumnsRenamed({"doc_id": "its_id", "row_key": "its_key", "source": "its_source"}).withColumn(
        "its_nth", F.row_number().over(again)
    )
    each = draws.join(numbered.where(F.col("taken") > 0), ["source_no", "block"])
    words = F.least(F.col("size"), F.col("taken") - F.col("round") * F.col("size"))
    each = each.withColumn("words", words).where(F.col("words") > 0).select(
        "its_id", "its_key", "its_source", "its_nth", "shard", "words",
        F.xxhash64(F.lit(seed), "shard", "round", "its_key", "its_source", "its_nth").alias("place"),
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("own_key"))
    own = Window.partitionBy("row.doc_id", "own_key", "row.source").orderBy("own_key")
    rows = rows.withColumn("own_nth", F.row_number().over(own))
    on = (
        F.col("row.doc_id").eqNullSafe(F.col("its_id")) & (F.col("own_key") == F.col("its_key"))
        & F.col("row.source").eqNullSafe(F.col("its_source")) & (F.col("own_nth") == F.col("its_nth"))
    )
    return rows.join(each, on).select("shard", "place", "words", "row").repartition("shard").sortWithinPartitions(
        "shard", "place"
    )
