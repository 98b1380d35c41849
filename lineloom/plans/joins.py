"""Joins that hold when one key carries a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The few side of a comparison join is broadcast up to this many characters of text and rows.
BROADCAST_CHARS = 32 * 1024 * 1024
BROADCAST_ROWS = 500_000

# Keys below this many rows are never worth splitting.
HOT_ROWS = 200_000

# Several tasks a core, so that one that is slow does not hold the stage.
TASKS_A_CORE = 4


def hot_keys(counts: DataFrame, keys: Sequence[str], weight: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys that hold more than one task's share of the rows, as ``(__hash, __copies)``; None where there is none.

    A key is hot above ``total / shuffle partitions`` rows, so there are fewer hot keys than shuffle partitions: that
    bound, and the 12 bytes per row, is what makes the broadcast of this table safe whatever the data.
    """
    spark = counts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, largest = counts.agg(F.sum(weight), F.max(weight)).first()
    share = max((total or 0) // tasks, hot_rows)
    if (largest or 0) <= share:
        return None
    hot = (
        counts.groupBy(F.xxhash64(*keys).alias("__hash")).agg(F.sum(weight).alias("n"))
        .where(F.col("n") > share)
        .select("__hash", F.ceil(F.col("n") / share).cast("int").alias("__copies"))
    )
    return hot


def spread_join(
    many: DataFrame,
    few: DataFrame,
    keys: Sequence[str],
    hot: DataFrame | None,
    spread: str,
    how: str = "inner",
    condition: Column | None = None,
) -> DataFrame:
    """Join on ``keys``; rows of a hot key are dealt over several tasks and the other side is copied to each.

    ``condition`` may use ``many.<column>`` and ``few.<column>``.  The result has the columns of ``many`` (and of
    ``few`` for inner and left joins, less the keys).
    """
    keys = list(keys)
    if hot is not None:
        hot = F.broadcast(hot)

        def with_copies(df: DataFrame) -> DataFrame:
            hashed = df.withColumn("__hash", F.xxhash64(*keys))
            return hashed.join(hot, "__hash", "left").withColumn("__copies", F.coalesce("__copies", F.lit(1)))

        many = with_copies(many).withColumn("__salt", F.pmod(F.xxhash64(spread), "__copies").cast("int"))
        few = with_copies(few).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
        many, few = many.drop("__hash", "__copies"), few.drop("__hash", "__copies")
        keys = keys + ["__salt"]
    on = F.lit(True)
    for key in keys:
        on = on & (F.col(f"many.{key}") == F.col(f"few.{key}"))
    if condition is not None:
        on = on & condition
    joined = many.alias("many").join(few.alias("few"), on, how)
    out = [F.col(f"many.{c}") for c in many.columns if c != "__salt"]
    if how in ("inner", "left"):
        out += [F.col(f"few.{c}") for c in few.columns if c not in keys]
    return joined.select(*out)


def fits_broadcast(df: DataFrame, text: str) -> bool:
    """Measure ``df`` and its ``text`` array column: may it be sent to every executor?"""
    size = F.coalesce(F.sum(F.aggregate(text, F.lit(0).cast("bigint"), lambda a, t: a + F.length(t) + 16)), F.lit(0))
    rows, chars = df.agg(F.count(F.lit(1)), size).first()
    return rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS


def compare_join(
    many: DataFrame,
    few: DataFrame,
    bucket: str,
    condition: Column,
    how: str = "inner",
    spread: str = "First",
    text: str = "Tokens",
) -> DataFrame:
    """Every row of ``many`` against the rows of ``few`` in its bucket, under ``condition``.

    ``few`` is broadcast where its measured size allows; beyond that both sides are shuffled by bucket, with large
    buckets dealt over many tasks.  ``text`` names the token column of ``few``.
    """
    if fits_broadcast(few, text):
        return spread_join(many, F.broadcast(few), [bucket], None, spread, how, condition)
    counts = many.groupBy(bucket).agg(F.count(F.lit(1)).alias("rows"))
    return spread_join(many, few, [bucket], hot_keys(counts, [bucket], "rows", 10_000), spread, how, condition)


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Deal a source that arrives in fewer splits than there are cores (one big row group, say) over ``TASKS_A_CORE`` tasks a core.

    A source with enough splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(TASKS_A_CORE * cores, key)
