"""Iterative partitioning (H2): by length, by the steadiest word position, by the mapping of two positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lineloom.functions.masking import SEP
from lineloom.operators.leader import merge_template
from lineloom.operators.mining import Mining, label_clusters
from lineloom.operators.words import distinct_messages, word_lines
from lineloom.plans.joins import hot_keys, spread_join
from lineloom.workspace import Workspace


def _column_words(parts: DataFrame) -> DataFrame:
    """``Part, Pos, Words``: distinct words per position."""
    cells = parts.select("Part", F.posexplode("Tokens").alias("Pos", "Word"))
    return cells.groupBy("Part", "Pos", "Word").agg(F.lit(1)).groupBy("Part", "Pos").agg(
        F.count(F.lit(1)).alias("Words")
    )


def _with_part_info(parts: DataFrame, info: DataFrame, how: str = "left") -> DataFrame:
    counts = parts.groupBy("Part").agg(F.count(F.lit(1)).alias("rows"))
    return spread_join(parts, info, ["Part"], hot_keys(counts, ["Part"], "rows", 10_000), "First", how)


def _by_position(parts: DataFrame) -> DataFrame:
    split = _column_words(parts).groupBy("Part").agg(F.min(F.struct("Words", "Pos")).alias("Best"))
    placed = _with_part_info(parts, split.select("Part", F.col("Best.Pos").alias("At")))
    word = F.coalesce(F.get("Tokens", F.col("At")), F.lit(""))
    return placed.withColumn("Part", F.concat_ws(SEP, "Part", word)).drop("At")


def _by_mapping(parts: DataFrame, lower: float, ws: Workspace) -> DataFrame:
    # the two positions whose number of words is the most common one; at most one row per position and part
    words = _column_words(parts).where(F.col("Words") > 1)
    alike = Window.partitionBy("Part", "Words")
    order = Window.partitionBy("Part").orderBy(F.desc("Alike"), "Words", "Pos")
    ranked = words.withColumn("Alike", F.count(F.lit(1)).over(alike)).withColumn("Place", F.row_number().over(order))
    chosen = (
        ranked.where(F.col("Place") <= 2).groupBy("Part")
        .agg(F.min("Pos").alias("P1"), F.max("Pos").alias("P2"))
        .where(F.col("P1") < F.col("P2"))
    )
    placed = ws.table(
        _with_part_info(parts, chosen).withColumn("A", F.get("Tokens", F.col("P1")))
        .withColumn("B", F.get("Tokens", F.col("P2"))).drop("P1", "P2"),
        "mapped-columns",
    )
    pairs = ws.table(
        placed.where(F.col("A").isNotNull()).groupBy("Part", "A", "B").agg(
            F.sum("n").alias("Lines"), F.count(F.lit(1)).alias("rows")
        ),
        "word-pairs",
    )

    def degree(side: str, name: str) -> DataFrame:
        return ws.table(pairs.groupBy("Part", side).agg(F.count(F.lit(1)).alias(name)), name)

    deg_a, deg_b = degree("A", "DegA"), degree("B", "DegB")
    linked = ws.table(
        _attach(_attach(pairs, deg_a, "A", deg_a, "DegA"), deg_b, "B", deg_b, "DegB"), "linked"
    )

    def relation(side: str, far: str, name: str) -> DataFrame:
        """The largest degree on the other side, and the share of distinct words among the lines."""
        return linked.groupBy("Part", side).agg(
            F.max(far).alias(f"Far{name}"),
            F.try_divide(F.count(F.lit(1)).cast("double"), F.sum("Lines").cast("double")).alias(f"Share{name}"),
        )

    of_a, of_b = relation("A", "DegB", "A"), relation("B", "DegA", "B")
    linked = _attach(_attach(linked, of_a, "A", deg_a, "DegA"), of_b, "B", deg_b, "DegB")
    one_many = (F.col("DegA") > 1) & (F.col("FarA") == 1)
    many_one = (F.col("DegB") > 1) & (F.col("FarB") == 1)
    key = (
        F.when((F.col("DegA") == 1) & (F.col("DegB") == 1), F.concat_ws(SEP, F.lit("1-1"), "A", "B"))
        .when(one_many & (F.col("ShareA") <= lower), F.concat_ws(SEP, F.lit("1-M"), "B"))
        .when(one_many, F.concat_ws(SEP, F.lit("1-M"), "A"))
        .when(many_one & (F.col("ShareB") <= lower), F.concat_ws(SEP, F.lit("M-1"), "A"))
        .when(many_one, F.concat_ws(SEP, F.lit("M-1"), "B"))
        .otherwise("M-M")
    )
    keyed = ws.table(linked.select("Part", "A", "B", key.alias("Key"), "rows"), "relations")
    unmapped = placed.where(F.col("A").isNull()).drop("A", "B")
    mapped = spread_join(
        placed.where(F.col("A").isNotNull()), keyed.drop("rows"), ["Part", "A", "B"],
        hot_keys(keyed, ["Part", "A", "B"], "rows", 10_000), "First",
    )
    mapped = mapped.withColumn("Part", F.concat_ws(SEP, "Part", "Key")).drop("A", "B", "Key")
    return mapped.unionByName(unmapped)


def _attach(linked: DataFrame, info: DataFrame, side: str, degrees: DataFrame, name: str) -> DataFrame:
    """Join what is known per word of one side; a word with many partners is dealt out by its partners."""
    hot = hot_keys(degrees, ["Part", side], name, 10_000)
    return spread_join(linked, info, ["Part", side], hot, "B" if side == "A" else "A")


def mine_iplom(messages: DataFrame, lower: float = 0.25, masks: Sequence[str] = ()) -> Mining:
    """H2.  On the many side of a mapping, words are constants where their number is at most ``lower`` of the lines."""
    ws = Workspace(messages.sparkSession)
    sigs = distinct_messages(ws.table(word_lines(messages, masks), "lines"), ws)
    parts = sigs.withColumn("Part", F.col("Bucket"))
    parts = ws.table(_by_position(parts), "by-position")
    parts = ws.table(_by_mapping(parts, lower, ws), "by-mapping")
    oldest = parts.groupBy("Part").agg(F.min("First").alias("ClusterId"))
    members = ws.table(_with_part_info(parts, oldest, "inner").drop("Part"), "members")
    clusters = merge_template(members, delimiters=False)
    return Mining(
        members.select("Signature", "n", "ClusterId"), ws.table(label_clusters(clusters, " "), "rendered"), "Signature"
    )
