"""Template mining in line order (D2): the exact one-pass result, without sending a whole length through one task.

Line by line, each message joins the most similar template of its length or opens a new one, and the template is
merged with the message at once.  A line only matters to later ones if it *changes* the templates, and for fixed
templates that depends on its signature alone.  So each round, per bucket:

1. all distinct signatures are compared with the current templates in parallel; this yields the cluster of every
   signature and whether it would change anything;
2. the next line that changes something is found; every line before it is assigned in parallel;
3. from that line on, the lines of one bounded range of line numbers are replayed in order in one task.

Line ids are unique integers, so a range of ``window`` ids holds at most ``window`` lines however hot its bucket is.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lineloom.functions.masking import SEP, WILDCARD
from lineloom.functions.similarity import pair_similarity
from lineloom.operators.leader import DELIMITER_START, merged_tokens
from lineloom.operators.matching import best_match
from lineloom.plans.joins import hot_keys, spread_join
from lineloom.workspace import Workspace

CLUSTER_SCHEMA = "Bucket string, ClusterId bigint, Tokens array<string>"
_DELIMITER = re.compile(DELIMITER_START)

#: Messages that a replay remembers while its templates stay as they are; a message that was forgotten is compared again.
SETTLED = 10_000


class Replay:
    """The templates of one bucket, and the rule that takes in the next message."""

    def __init__(self, clusters, method: str, st: float, n: int, delimiters: bool = True):
        self.delimiters = delimiters
        self.clusters: list[list] = [[cid, tuple(tokens)] for cid, tokens in sorted(clusters)]
        self.measure = (method, n)
        self.st = st
        self._settled: dict[tuple, int] = {}

    def take(self, line_id: int, tokens: tuple) -> int:
        known = self._settled.get(tokens)
        if known is not None:
            return known
        home, best = None, -1.0
        for cluster in self.clusters:
            score = pair_similarity(cluster[1], tokens, *self.measure) if tokens else 1.0
            if score >= self.st and score > best:
                home, best = cluster, score
        if home is None:
            home = [line_id, tokens]
            self.clusters.append(home)
            self._settled.clear()
            return line_id
        merged = tuple(
            new if new == old or (self.delimiters and _DELIMITER.match(new)) else WILDCARD
            for new, old in zip(tokens, home[1])
        )
        if " ".join(merged) != " ".join(home[1]):
            home[1] = merged
            self._settled.clear()
        else:
            if len(self._settled) >= SETTLED:
                self._settled.clear()
            self._settled[tokens] = home[0]
        return home[0]


def _replay_window(method: str, st: float, n: int, delimiters: bool):
    def run(lines: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        bucket = lines["Bucket"].iloc[0]
        replay = Replay(zip(known["ClusterId"], known["Tokens"]), method, st, n, delimiters)
        lines = lines.sort_values("LineId")
        homes = [
            replay.take(line_id, tuple(signature.split(SEP)) if signature else ())
            for line_id, signature in zip(lines["LineId"], lines["Signature"])
        ]
        taken = pd.DataFrame({"Bucket": bucket, "LineId": lines["LineId"].to_numpy(), "ClusterId": homes})
        taken["Tokens"] = None
        state = pd.DataFrame(
            [(bucket, None, cid, list(tokens)) for cid, tokens in replay.clusters],
            columns=["Bucket", "LineId", "ClusterId", "Tokens"],
        )
        out = pd.concat([taken.astype({"LineId": "Int64"}), state.astype({"LineId": "Int64"})])
        return out

    return run


def mine_sequential(
    lines: DataFrame,
    sigs: DataFrame,
    method: str,
    st: float,
    n: int,
    ws: Workspace,
    window: int = 65_536,
    known: DataFrame | None = None,
    delimiters: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(LineId -> ClusterId, clusters)``; ``known`` holds templates of earlier lines (``CLUSTER_SCHEMA``).

    ``lines`` has ``Bucket, LineId, Signature``; ``sigs`` is its written signature table with tokens.
    """
    spark = lines.sparkSession
    hot = hot_keys(sigs, ["Signature"], "n")
    ids = ws.table(
        spread_join(
            lines.select("Bucket", "LineId", "Signature"), sigs.select("Signature", "First"), ["Signature"], hot,
            "LineId",
        ),
        "line-signatures",
    )
    # from here on a signature is known by its first line
    hot = None if hot is None else hot_keys(sigs, ["First"], "n")
    state = ws.table(known, "known") if known is not None else spark.createDataFrame([], CLUSTER_SCHEMA)
    frontier = sigs.groupBy("Bucket").agg(F.min("First").alias("At"))
    paths: list[str] = []

    def attach(df: DataFrame, table: DataFrame) -> DataFrame:
        return spread_join(df, table, ["First"], hot, "LineId")

    if known is None:
        # nothing is known yet, so the first line of every bucket is the first to change something
        turn = ws.table(frontier.withColumnRenamed("At", "Next"), "turning-points")
        ahead = ids
    else:
        turn, ahead = _skip(ids, sigs, state, frontier, (method, st, n, delimiters), attach, ws, paths)
    while True:
        low = turn.agg(F.min("Next")).first()[0]
        if low is None:
            break
        stretch = ahead.join(turn, "Bucket").where(
            (F.col("LineId") >= F.col("Next")) & (F.col("LineId") < F.col("Next") + window)
        )
        stretch = attach(stretch.select("Bucket", "LineId", "First"), sigs.select("First", "Signature"))
        replayed = stretch.groupBy("Bucket").cogroup(
            state.join(turn.select("Bucket"), "Bucket", "left_semi").groupBy("Bucket")
        ).applyInPandas(
            _replay_window(method, st, n, delimiters),
            "Bucket string, LineId bigint, ClusterId bigint, Tokens array<string>",
        )
        paths.append(ws.path("replayed"))
        replayed.write.parquet(paths[-1])
        replayed = spark.read.schema(replayed.schema).parquet(paths[-1])
        state = ws.table(
            state.join(turn.select("Bucket"), "Bucket", "left_anti").unionByName(
                replayed.where(F.col("LineId").isNull()).select("Bucket", "ClusterId", "Tokens")
            ),
            "state",
        )
        frontier = turn.select("Bucket", (F.col("Next") + window).alias("At"))
        ahead = ids.where(F.col("LineId") >= low + window)
        turn, ahead = _skip(ahead, sigs, state, frontier, (method, st, n, delimiters), attach, ws, paths)

    members = spark.read.schema("LineId bigint, ClusterId bigint").parquet(*paths)
    return members.where(F.col("LineId").isNotNull()), state


def _skip(
    ids: DataFrame, sigs: DataFrame, state: DataFrame, frontier: DataFrame, measure: tuple, attach, ws: Workspace,
    paths: list[str],
) -> tuple[DataFrame, DataFrame]:
    """Assign, in every bucket, the lines from the frontier up to the next one that changes a template.

    Returns the turning points ``Bucket, Next`` (none for a bucket that is done) and the lines from the frontier on.
    """
    method, st, n, delimiters = measure
    ahead = ids.join(frontier, "Bucket").where(F.col("LineId") >= F.col("At"))
    active = sigs.join(frontier, "Bucket").where(F.col("Last") >= F.col("At"))
    best = best_match(active, state, method, st, n).select("First", "ClusterId")
    texts = state.select("ClusterId", F.col("Tokens").alias("Known"))
    merged = merged_tokens(F.col("Tokens"), F.col("Known"), delimiters)
    changes = F.col("ClusterId").isNull() | (F.array_join(merged, " ") != F.array_join("Known", " "))
    behaviour = ws.table(
        active.join(best, "First", "left").join(texts, "ClusterId", "left").select(
            "First", "Bucket", "At", "ClusterId", changes.alias("Changes")
        ),
        "behaviour",
    )
    changing = behaviour.where("Changes")
    fresh = changing.where(F.col("First") >= F.col("At")).groupBy("Bucket").agg(F.min("First").alias("Next"))
    again = changing.where(F.col("First") < F.col("At")).select("First")
    later = attach(ahead, again).groupBy("Bucket").agg(F.min("LineId").alias("Next"))
    turn = ws.table(
        fresh.unionByName(later).groupBy("Bucket").agg(F.min("Next").alias("Next")), "turning-points"
    )
    quiet = ahead.join(turn, "Bucket", "left").where(F.col("Next").isNull() | (F.col("LineId") < F.col("Next")))
    paths.append(ws.path("quiet"))
    attach(quiet.select("LineId", "First"), behaviour.select("First", "ClusterId")).select(
        "LineId", "ClusterId"
    ).write.parquet(paths[-1])
    return turn, ahead.drop("At")
