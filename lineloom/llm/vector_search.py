"""Nearest vectors by cosine over balanced posting lists.

Centroids are fitted on a bounded sample by splitting the largest cluster in two until all are small, so lists
have similar sizes.  They stay in the memory of each task, linked by a neighbour graph (nearest centroids and a few random
ones), and a best-first beam search over that graph finds the centroids near a vector, for a batch of vectors
at a time.  Every vector is written to the lists of its nearest centroid and, if it lies at a boundary, of all centroids at most
``closure`` times as far.  A query reads the lists whose centroids are within ``ratio`` of its nearest one.

Equal vectors are one entry: only the ``k + 1`` smallest ids of each can be among the answers, and equal queries are
searched once.  Long lists are cut into pieces by a hash, and the best of all pieces are merged, so no list is a single task's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lineloom.workspace import Workspace

NEAREST = 5
EVERY = 50
SAMPLE = 20_000
MOST_LISTS = 4_096
LIST_SIZE = 100
CLOSURE = 1.15
COPIES = 4
RATIO = 1.35
LISTS_READ = 48
BEAM = 96
PIECE = 4_096
SEED = 11


class CentroidGraph:
    def __init__(self, centroids: np.ndarray, degree: int = 24, random_links: int = 8, entries: int = 16):
        draw = np.random.default_rng(SEED)
        self.centroids = centroids
        count = len(centroids)
        near = []
        for at in range(0, count, 512):
            part = centroids[at:at + 512] @ centroids.T
            near.append(np.argsort(-part, axis=1, kind="stable")[:, :degree + 1])
        links = draw.integers(0, count, (count, random_links))
        self.links = np.concatenate([np.concatenate(near), links], axis=1)
        self.entries = draw.permutation(count)[:entries]

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of about the ``beam`` nearest centroids of each vector, nearest first."""
        count, rows = len(self.centroids), np.arange(len(vectors))
        beam = min(beam, count)
        seen = np.zeros((len(vectors), count), bool)
        ids = np.tile(self.entries, (len(vectors), 1))
        seen[rows[:, None], ids] = True
        nearness = vectors @ self.centroids[self.entries].T
        waiting = np.ones_like(ids, bool)
        while True:
            best = np.where(waiting, nearness, -np.inf).argmax(axis=1)
            active = waiting[rows, best]
            if not active.any():
                break
            waiting[rows, best] = False
            around = self.links[ids[rows, best]]
            fresh = ~seen[rows[:, None], around] & active[:, None]
            seen[rows[:, None], around] |= active[:, None]
            # an id twice among the links of one node counts once
            order = np.sort(around, axis=1)
            if (order[:, 1:] == order[:, :-1]).any():
                at = np.argsort(around, axis=1, kind="stable")
                twice = np.zeros_like(fresh)
                np.put_along_axis(twice, at[:, 1:], order[:, 1:] == order[:, :-1], axis=1)
                fresh &= ~twice
            values = np.where(fresh, np.einsum("rd,rld->rl", vectors, self.centroids[around]), -np.inf)
            ids = np.concatenate([ids, around], axis=1)
            nearness = np.concatenate([nearness, values], axis=1)
            waiting = np.concatenate([waiting, fresh], axis=1)
            if ids.shape[1] > beam:
                top = np.argpartition(-nearness, beam - 1, axis=1)[:, :beam]
                ids, nearness, waiting = (np.take_along_axis(x, top, axis=1) for x in (ids, nearness, waiting))
                waiting &= np.isfinite(nearness)
        top = np.argsort(-nearness, axis=1, kind="stable")
        ids, nearness = np.take_along_axis(ids, top, axis=1), np.take_along_axis(nearness, top, axis=1)
        return ids, np.sqrt(np.maximum(0, 2 - 2 * nearness))  # between unit vectors; unused places are infinitely far


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector by the power of two that brings its largest component to about 1: exact, no cosine changes, and no square leaves the range."""
    vectors = np.asarray(vectors, np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Split the largest cluster in two halves along its widest direction, until there are ``lists``."""
    draw = np.random.default_rng(SEED)
    clusters = [sample]
    while len(clusters) < lists:
        largest = max(range(len(clusters)), key=lambda i: len(clusters[i]))
        members = clusters.pop(largest)
        if len(members) < 2:
            clusters.append(members)
            break
        centred = members - members.mean(axis=0)
        direction = draw.standard_normal(members.shape[1])
        for _ in range(6):  # power iteration
            direction = centred.T @ (centred @ direction)
            length = np.linalg.norm(direction)
            if not length:
                break
            direction /= length
        order = np.argsort(centred @ direction, kind="stable")
        half = len(order) // 2
        clusters += [members[order[:half]], members[order[half:]]]
    centres = np.array([c.mean(axis=0) for c in clusters])
    lengths = np.linalg.norm(centres, axis=1, keepdims=True)
    return np.where(lengths > 0, centres / np.where(lengths > 0, lengths, 1), 0)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part."""
    doubles = F.col(vector).cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", doubles.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite_or_false(finite)
        & F.exists("vector", lambda x: x != 0)
    )


def finite_or_false(test):
    return F.coalesce(test, F.lit(False))


def _places(graph: CentroidGraph, beam: int, ratio: float, most: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                ids, far = graph.search(_unit(np.stack(part["vector"].to_numpy())), beam)
                ids, far = ids[:, :most], far[:, :most]
                # a vector that sits on its centroid still reads its neighbours up to a small distance
                row, place = np.nonzero(far <= np.maximum(far[:, :1] * ratio, 1e-9))
                out = part.iloc[row].copy()
                out["list"] = ids[row, place]
                yield out

    return run


def _best(k: int):
    def run(key, entries: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(entries) or not len(questions):
            return empty
        raw, asked = _scaled(np.stack(entries["vector"].to_numpy())), _scaled(np.stack(questions["vector"].to_numpy()))
        lengths, ids = np.sqrt((raw * raw).sum(axis=1)), entries["vec_id"].to_numpy()
        unit, out = _unit(raw), []
        for query, vector in zip(questions["query_id"].to_numpy(), asked):
            rough = unit @ (vector / np.linalg.norm(vector))
            limit = np.partition(rough, -min(k, len(rough)))[-min(k, len(rough))]
            near = np.flatnonzero(rough >= limit - 1e-9)
            score = (raw[near] * vector).sum(axis=1) / (lengths[near] * np.sqrt((vector * vector).sum()))
            order = np.lexsort((ids[near], -score))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near][order], "score": score[order]}))
        return pd.concat(out)

    return run


def nearest_vectors(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = NEAREST,
    vector: str = "embedding",
    ratio: float = RATIO,
    lists_read: int = LISTS_READ,
    closure: float = CLOSURE,
    copies: int = COPIES,
    beam: int = BEAM,
    sample: int = SAMPLE,
    workspace: Workspace | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors found for each row of ``queries``, its own id left out.

    Vectors that are null, zero or hold null or non-finite components take no part on either side, nor do those of another length than most
    have (of equally frequent lengths the larger one counts).  Rows that repeat an id and vector count once.
    """
    spark = vectors.sparkSession
    workspace = workspace or Workspace(spark)
    entries, asked = usable(vectors, vector), usable(queries, vector)
    # of equal vectors only the smallest ids can be answers, repeated rows counted once; Spark limits each group before it shuffles
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    entries = entries.distinct().withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1).drop("nth")
    entries = workspace.table(entries, "entries")
    widths = entries.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    usual = widths.orderBy(F.desc("n"), F.desc("width")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if usual is None:
        return empty
    count, as_usual = usual["n"], F.size("vector") == usual["width"]
    entries, asked = entries.where(as_usual), asked.where(as_usual)
    rows = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").collect()
    lists = max(1, min(MOST_LISTS, count // LIST_SIZE, len(rows)))
    graph = CentroidGraph(balanced_centroids(_unit(np.array([r["vector"] for r in rows])), lists))

    posted = entries.mapInPandas(
        _places(graph, min(beam, 4 * copies + 16), closure, copies), "vec_id bigint, vector array<double>, list bigint"
    )
    posted = workspace.table(posted, "lists")
    distinct = asked.groupBy("vector").agg(F.min("vec_id").alias("query_id"))
    distinct = workspace.table(distinct, "questions")
    read = distinct.mapInPandas(
        _places(graph, beam, ratio, lists_read), "vector array<double>, query_id bigint, list bigint"
    )
    sizes = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    sizes = F.broadcast(sizes)  # a row for each centroid, MOST_LISTS at most
    posted = posted.join(sizes, "list").withColumn("piece", F.pmod(F.xxhash64("vec_id"), "pieces").cast("int")).drop("pieces")
    read = read.join(sizes, "list").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    found = posted.groupBy("list", "piece").cogroup(read.groupBy("list", "piece")).applyInPandas(
        _best(k + 1), "query_id bigint, vec_id bigint, score double"
    ).distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    own = asked.select(F.col("vec_id").alias("own_id"), "vector").distinct().join(distinct, "vector").select("own_id", "query_id")
    answers = own.join(found, "query_id").where(F.col("own_id") != F.col("vec_id"))
    ranked = Window.partitionBy("own_id").orderBy(F.col("score").desc(), "vec_id")
    answers = answers.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return answers.select(F.col("own_id").alias("query_id"), "rank", "vec_id", "score")
