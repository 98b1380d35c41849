"""The fit against plain loops, and what the driver holds for it."""

import math
import re
import tracemalloc

import numpy as np
import pytest

from lineloom.llm import toxicity


def made(spark, count, lines, width, vocabulary):
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(vocabulary)]
    docs, labels = [(1000, ""), (1001, "..."), (1002, None)], [(1000, 0), (1001, 1), (1002, 1), (1, None)]
    for i in range(count):
        text = "\n".join(" ".join(words[k] for k in rng.integers(0, vocabulary, width)) + "." for _ in range(lines))
        docs.append((i, text + (" nasty Words!" if i % 4 == 0 else "")))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def plain_fit(docs, labels, weights, rounds, min_docs=4, rate=0.1, sparsity=3e-4):
    """Bias and weights by loops over documents, sentences and features."""
    bags = [[{f for w in re.findall(r"[^\W\d_]+", s.lower()) for f in ["=" + w] + [w[:n] for n in (3, 4, 5, 6) if len(w) >= n]}
             for s in re.findall(r"[^.!?\n]+", text)] for text in docs]
    held = [f for bag in bags for f in set().union(*bag)]
    names = {f for f in set(held) if held.count(f) >= min_docs}
    bags = [[s & names for s in bag] for bag in bags]
    theta, first, second = ({f: v for f in [*names, ""]} for v in (0.0, 0.0, 0.0))
    theta[""] = -6.0
    share = [weights[y] / sum(weights[x] for x in labels) for y in labels]
    for step in range(1, rounds + 1):
        gradient = dict.fromkeys(theta, 0.0)
        for bag, y, own in zip(bags, labels, share):
            p = [1 / (1 + math.exp(-theta[""] - sum(theta[f] for f in s))) for s in bag]
            clean = math.prod(1 - x for x in p)
            for s, x in zip(bag, p):
                for f in [*s, ""]:
                    gradient[f] += x * own * (-clean / max(1 - clean, 1e-9) if y else 1)
        for f, g in gradient.items():
            first[f] = 0.9 * first[f] + 0.1 * g
            second[f] = 0.99 * second[f] + 0.01 * g * g
            scale = rate / (math.sqrt(second[f] / (1 - 0.99**step)) + 1e-10)
            theta[f] -= scale * first[f] / (1 - 0.9**step)
            if f:
                theta[f] = math.copysign(max(abs(theta[f]) - scale * sparsity, 0), theta[f])
    return theta.pop(""), {f: w for f, w in theta.items() if abs(w) > 1e-3}


@pytest.mark.parametrize("block", [1, 500, 1 << 18])
def test_fit_equals_plain_loops(spark, monkeypatch, block):
    monkeypatch.setattr(toxicity, "_BLOCK", block)
    docs, labels = made(spark, 60, 4, 6, 40)
    model = toxicity.train(docs, labels, rounds=8)
    learned = {r.doc_id for r in labels.where(~toxicity.held_out()).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in learned and r.text is not None)
    toxic = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    every, own = ([toxic[d] for d in ids] for ids in (learned & toxic.keys(), [d for d, _ in rows]))
    weights = [every.count(y) / own.count(y) * (toxicity.TOXIC_WEIGHT if y else 1) for y in (0, 1)]
    bias, expected = plain_fit([t for _, t in rows], own, weights, 8)
    assert expected and model.weights.keys() == expected.keys()
    assert model.bias == pytest.approx(bias) and model.weights == pytest.approx(expected)


def test_one_class_gives_a_constant(spark):
    docs, labels = made(spark, 20, 2, 4, 20)
    for kept, bias in (("toxic = 0", -12.0), ("toxic = 1", 0.0), ("false", -12.0)):
        assert toxicity.train(docs, labels.where(kept)) == toxicity.ToxicityModel(bias, {})


def test_the_driver_holds_a_few_bytes_a_feature(spark):
    docs, labels = made(spark, 150, 100, 18, 3000)
    docs = docs.repartition(4).cache()
    features = 2 / 3 * 150 * 100 * 18 * 4  # of the sentences learned from, at least
    tracemalloc.start()
    try:
        toxicity.train(docs, labels, rounds=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * features + 30e6, peak
