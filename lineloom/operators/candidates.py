"""Which messages and templates can be similar at all: an inverted index of rare tokens.

A pair at the threshold shares a known number of items, ``(position, token)`` for the positional measure and tokens for Jaccard.  Ordered from
rare to frequent, two sets that share ``o`` items share one of the first ``size - o + 1`` of each.  Only these prefixes are joined, so the
pairs follow the rare tokens that messages have in common and not the number of messages of one length.  Blanks come last in this order, whatever
their number: where a prefix ends before them, which a threshold of a half already brings about, they are not even counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lineloom.functions.masking import SEP, WILDCARD, marked_to_tokens
from lineloom.plans.joins import fits_broadcast, hot_keys, spread_join
from lineloom.workspace import Workspace

#: Where no bucket has more templates than these, every message meets all of its bucket: that is cheaper than an index.
DIRECT = 256


def use_index(few: DataFrame, method: str, st: float) -> bool:
    """An n-gram ratio has no such item sets, and a threshold of 0 asks for no common item."""
    if method not in ("seqDist", "jaccard") or st <= 0:
        return False
    busiest = few.groupBy("Bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (busiest or 0) > DIRECT


def _items(df: DataFrame, key: str, method: str, st: float) -> DataFrame:
    """``key, Prefix, Size, Item, Blank``: the items of each row, how many of them are no blanks, and how many of the rarest a partner must share one of."""
    def blank(token: Column) -> Column:
        return F.trim(token) == ""

    def item(token: Column, *place: Column) -> Column:
        return F.struct(F.xxhash64("Bucket", *place, token).alias("Item"), blank(token).alias("Blank"))

    if method == "jaccard":
        items = F.transform(F.array_distinct("Tokens"), lambda token: item(token))
        size = F.size(F.array_distinct("Tokens"))
        need = F.ceil(size * F.lit(st) - 1e-9)
    else:
        # a wildcard of the template matches nothing, so neither side needs it
        held = F.transform("Tokens", lambda token, i: F.when(token != WILDCARD, item(token, i)))
        items = F.filter(held, lambda x: x.isNotNull())
        size = F.size(items)
        need = F.ceil(F.size("Tokens") * F.lit(st) - 1e-9)
    rows = df.select(key, (size - F.greatest(need, F.lit(1)) + 1).cast("int").alias("Prefix"), items.alias("Items")).where("Prefix > 0")
    rows = rows.withColumn("Words", F.filter("Items", lambda x: ~x["Blank"]))
    asked = F.when(F.col("Prefix") <= F.size("Words"), F.col("Words")).otherwise(F.col("Items"))
    return rows.select(key, "Prefix", F.size("Words").alias("Size"), F.explode(asked).alias("i")).select(key, "Prefix", "Size", "i.*")


def prefixes(items: DataFrame, key: str) -> DataFrame:
    """``key, Item``: the rarest known items that belong to the prefix; items that no template holds take the first places.

    ``Size`` counts the items that are no ``Blank`` (a column that may be missing); blanks come behind all of them.
    """
    blank = F.col("Blank") if "Blank" in items.columns else F.lit(False)
    entry = F.struct(blank.alias("Blank"), "Holders", "Item")
    ranked = items.groupBy(key, "Prefix", "Size").agg(F.array_sort(F.collect_list(entry)).alias("Known"))
    places = F.col("Prefix") - (F.col("Size") - F.size(F.filter("Known", lambda x: ~x["Blank"])))
    return ranked.where(places > 0).select(key, F.explode(F.slice("Known", F.lit(1), places)).alias("k")).select(key, "k.Item")


def candidate_pairs(many: DataFrame, few: DataFrame, method: str, st: float, ws: Workspace) -> DataFrame:
    """``First, ClusterId`` of every pair within a bucket that may reach ``st``, and of some more."""
    templates = ws.table(_items(few, "ClusterId", method, st), "template-items")
    holders = ws.table(templates.groupBy("Item").agg(F.count(F.lit(1)).alias("Holders")), "holders")
    index = ws.table(prefixes(templates.join(holders, "Item"), "ClusterId"), "index")
    ws.drop(templates)
    asked = ws.table(prefixes(_items(many, "First", method, st).join(holders, "Item"), "First"), "asked")
    ws.drop(holders)
    ws.sweep()
    hot = hot_keys(asked.groupBy("Item").agg(F.count(F.lit(1)).alias("rows")), ["Item"], "rows", 10_000)
    return spread_join(asked, index, ["Item"], hot, "First").select("First", "ClusterId").distinct()


def indexed_join(
    many: DataFrame, few: DataFrame, method: str, st: float, condition: Column, bounds: Column | None, ws: Workspace
) -> DataFrame:
    """Every pair within a bucket that meets ``condition``, with the columns of both sides; ``few`` has ``Known`` for its tokens.

    ``condition`` and ``bounds`` name the sides ``many`` and ``few``; ``bounds`` reads ids only and thins out candidates before tokens are
    fetched.  Two empty sequences share no item and are joined by themselves.  Tokens of ``many`` hold no separator and are not empty.
    """
    scratch = Workspace(ws.spark)
    renamed = few.withColumnRenamed("Known", "Tokens")
    pairs = candidate_pairs(many, renamed, method, st, scratch)
    if bounds is not None:
        pairs = pairs.select(F.struct("First").alias("many"), F.struct("ClusterId").alias("few")).where(bounds).select("many.*", "few.*")
    empty = many.where(F.size("Tokens") == 0).select("Bucket", "First").join(
        few.where(F.size("Known") == 0).select("Bucket", "ClusterId"), "Bucket"
    ).select("First", "ClusterId")
    if bounds is not None:
        empty = empty.select(F.struct("First").alias("many"), F.struct("ClusterId").alias("few")).where(bounds).select("many.*", "few.*")
    pairs = ws.table(pairs.unionByName(empty), "candidates", "First")
    scratch.close()
    ws.sweep()
    # a marked string is a third of its tokens in a shuffle
    packed = many.withColumn("Tokens", F.array_join("Tokens", SEP)).join(pairs.withColumnRenamed("ClusterId", "__other"), "First")
    left = packed.withColumn("Tokens", marked_to_tokens(F.col("Tokens")))
    few = F.broadcast(few) if fits_broadcast(few, "Known") else few
    joined = left.alias("many").join(few.alias("few"), (F.col("many.__other") == F.col("few.ClusterId")) & condition)
    return joined.select(
        *[F.col(f"many.{c}") for c in many.columns], *[F.col(f"few.{c}") for c in few.columns if c != "Bucket"]
    )
