"""Near copies: dense clusters about the threshold, repeated ids, contraction of edges."""

import numpy as np
import pytest

from lineloom.llm import components, near_duplicates
from lineloom.workspace import Workspace


def roots(nodes, edges):
    part = {n: n for n in nodes}

    def find(n):
        while part[n] != n:
            part[n] = part[part[n]]
            n = part[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        part[b] = a
    return {n: find(n) for n in nodes}


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def cluster(seed):
    """Copies of two texts with changes that leave many pairs just above or below the threshold, and texts around a shared passage."""
    rng = np.random.default_rng(seed)
    out = []
    for base, size in ((0, 90), (1, 40)):
        words = [f"b{base}w{i}" for i in range(110)]
        for _ in range(size):
            own = list(words)
            for _ in range(rng.integers(0, 5)):
                own[rng.integers(0, len(own))] = f"x{rng.integers(0, 40)}"
            if rng.random() < 0.3:
                own = own[:rng.integers(80, 110)]
            out.append(" ".join(own))
    passage = " ".join(f"p{i}" for i in range(60))
    out += [passage + " " + " ".join(f"t{rng.integers(0, 30)}" for _ in range(rng.integers(10, 40))) for _ in range(60)]
    return out


@pytest.mark.parametrize("percent, bands, rows, direct", [(80, 46, 6, 2), (80, 46, 6, 200), (85, 42, 7, 5)])
def test_dense_clusters(spark, percent, bands, rows, direct):
    texts = cluster(percent + direct)
    sets = [shingles(t) for t in texts]
    ids = range(len(texts))
    links = [(i, j) for i in ids for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(3)
    found = near_duplicates.near_duplicates(docs, percent=percent, bands=bands, rows=rows, direct=direct)
    assert {r.doc_id: r.component_id for r in found.collect()} == roots(ids, links)


def test_an_id_with_several_texts(spark):
    a, b = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    rows = [
        (1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:99] + ["x"])), (3, " ".join(b[:99] + ["y"])), (4, "on its own"),
        (5, "one more"), (5, "on its own"), (5, "one more"), (None, "one more"),
    ]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = [(r.doc_id, r.component_id, r.kept) for r in found.collect()]
    want = [(1, 1, True)] * 2 + [(2, 1, False), (3, 1, False), (4, 4, True)] + [(5, 4, False)] * 3 + [(None, 4, False)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("chunk", [7, 1_000_000])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(2000, 2000 + i) for i in range(50)] + [(-3, 2**60)]
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(4)
    found = {r.node: r.component for r in components.connected_components(df, Workspace(spark)).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert found == roots(nodes, [e for e in edges if e[0] != e[1]])
    none = components.connected_components(df.limit(0), Workspace(spark))
    assert none.collect() == []
