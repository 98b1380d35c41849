"""Connected components by alternating large-star and small-star rounds over written edge tables.

Before a round every task contracts the edges it holds anyway, a bounded number, to stars: what a combiner is to an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lineloom.workspace import Workspace

#: Edges that one task contracts at once.
CHUNK = 1_000_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the same components as the edges: every node but the smallest of its component, and that one."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[:len(u)], ends[len(u):]
    least = np.arange(len(nodes))
    while len(a):
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while True:  # to the roots
            jumped = least[least]
            if (jumped == least).all():
                break
            least = jumped
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    hung = least != np.arange(len(nodes))
    return nodes[hung], nodes[least[hung]]


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def stars() -> pa.RecordBatch:
        u, v = contract(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        rows += batch.num_rows
        if rows >= 2 * CHUNK:
            yield stars()
            held, rows = [], 0
    if held:
        yield stars()


def _contracted(edges: DataFrame, count: int) -> DataFrame:
    return edges.coalesce(-(-count // CHUNK) or 1).mapInArrow(_contract, "u bigint, v bigint")


def contracted_by(edges: DataFrame, key: str) -> DataFrame:
    """Stars with the same components, contracted by the tasks that hold the edges ``u, v`` of one key together."""
    return edges.repartition(key).select("u", "v").mapInArrow(_contract, "u bigint, v bigint")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("c")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    ).where(F.col("u") != F.col("v"))  # one edge for each edge; the small star that follows drops repeats


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def _fingerprint(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``, whole numbers; a component is named by its smallest node.

    A round aggregates smallest neighbours before the shuffle and joins them back, so a node with very many
    neighbours is no single task's work.  Nothing but two numbers for each round reaches the driver.
    """
    edges = workspace.table(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
        .distinct(), "edges",
    )
    count, _ = _fingerprint(edges)
    while True:
        edges = workspace.table(_contracted(edges, count), "contracted")
        before = _fingerprint(edges)
        edges = workspace.table(_small_star(_large_star(edges)), "stars")
        now = _fingerprint(edges)
        if now == before:
            break
        count, _ = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(centres)
