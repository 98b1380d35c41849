"""Paths and spans of repeated windows, compared with a graph in plain Python."""

import random
from collections import Counter, defaultdict

import pytest

from lineloom.llm import substring_dedup

WINDOW, SEED_WORDS = 6, 3


def graph_paths(texts, window):
    """Multiset of (distinct windows, places of the most frequent one) over the maximal nonbranching paths."""
    places = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    edges = [e for e, n in places.items() if n > 1]
    enters, leaves = defaultdict(list), defaultdict(list)
    for e in edges:
        enters[e[1:]].append(e)
        leaves[e[:-1]].append(e)
    root = {e: e for e in edges}

    def find(e):
        while root[e] != e:
            e = root[e]
        return e

    for node, ins in enters.items():
        if len(ins) == 1 and len(leaves[node]) == 1:
            root[find(ins[0])] = find(leaves[node][0])
    paths = defaultdict(list)
    for e in edges:
        paths[find(e)].append(places[e])
    return Counter((len(p), max(p)) for p in paths.values()), places


def samples():
    rng = random.Random(5)
    passages = [[f"p{i}w{k}" for k in range(40)] for i in range(3)]
    texts = []
    for i in range(60):
        text = [f"d{i}x{k}" for k in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 30)
            text += p[a:rng.randint(a, 40)] + [f"d{i}y{k}" for k in range(rng.randint(0, 3))]
        texts.append(text)
    # few different words: many branches, cycles and periods
    texts += [[rng.choice("ab") for _ in range(rng.randint(4, 40))] for _ in range(25)]
    texts += [["a"] * 20, ["a", "b", "c"] * 9, [], ["one"]]
    return texts


@pytest.mark.parametrize("repeat", [1, 2])
def test_paths_and_spans(spark, repeat):
    texts = samples() * repeat
    # the second run has every row twice
    rows = [(i % len(samples()), " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want, places = graph_paths(texts, WINDOW)
    paths = substring_dedup.repeated_paths(docs, WINDOW, SEED_WORDS).collect()
    assert Counter((p.n_edges, p.places) for p in paths) == want
    assert all(p.n_words == p.n_edges + WINDOW - 1 for p in paths)

    known = {p.path for p in paths}
    covered, path_of = defaultdict(set), {}
    for s in substring_dedup.repeated_spans(docs, WINDOW, SEED_WORDS).collect():
        assert s.path in known
        for i in range(s["first"], s["last"] + 1):
            covered[s.doc_id].add(i)
            # one window has the same path wherever it stands
            assert path_of.setdefault(tuple(texts[s.doc_id][i:i + WINDOW]), s.path) == s.path
    for doc, w in enumerate(samples()):
        assert covered[doc] == {i for i in range(len(w) - WINDOW + 1) if places[tuple(w[i:i + WINDOW])] > 1}
    assert set(path_of) == {e for e, n in places.items() if n > 1}


def test_null_ids_and_empty(spark):
    w = [f"w{k}" for k in range(12)]
    docs = spark.createDataFrame([(None, " ".join(w)), (None, "x " + " ".join(w)), (3, None), (4, "")], "doc_id bigint, text string")
    (path,) = substring_dedup.repeated_paths(docs, WINDOW, SEED_WORDS).collect()
    assert (path.n_edges, path.n_words, path.places) == (7, 12, 2)
    spans = substring_dedup.repeated_spans(docs, WINDOW, SEED_WORDS).collect()
    assert sorted((s.doc_id, s["first"], s["last"]) for s in spans) == [(None, 0, 6), (None, 1, 7)]
    empty = docs.where("doc_id < 0")
    assert substring_dedup.repeated_paths(empty, WINDOW, SEED_WORDS).count() == 0
    assert substring_dedup.repeated_spans(empty, WINDOW, SEED_WORDS).count() == 0
