"""Packing: pieces against the tokenizer itself, the plan against exact optima, places by a full check."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lineloom.llm import best_fit_packing as packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, part int, place bigint, number bigint, length string"
TEXTS = [
    None, "", "one", "don't  stop\n\n  now ", "Ünïcode — ça va? 日本語 🙂", "a<|endoftext|>b", "\x00\x7f\t ​", "x" * 20000,
    " " * 5000 + "y", "12345678901234567890", " ".join(f"word{i}" for i in range(4000)),
]


def rows():
    rng = np.random.default_rng(2)
    texts = TEXTS + [" ".join(f"w{rng.integers(0, 999)}" for _ in range(rng.integers(0, 300))) for _ in range(150)]
    out = [(i, t, 1, 1, 1, "c") for i, t in enumerate(texts)]
    return out + out[2:5] + [(None, "no id", None, None, None, None), (7, "same id, other text", 1, 1, 1, "c")]


def check(found, docs, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for doc, text, *_ in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    have, sequences = defaultdict(int), defaultdict(list)
    for r in found:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for places in sequences.values():
        places.sort()
        assert [p[0] for p in places] == [sum(p[1] for p in places[:i]) for i in range(len(places))]
        assert sum(p[1] for p in places) <= capacity
    return len(sequences), sum(r.length for r in found)


@pytest.mark.parametrize("capacity", [2048, 40])
def test_pieces_and_places(spark, capacity):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    count, tokens = check(packing.pack_documents(docs, PATH, capacity).collect(), rows(), capacity)
    assert count <= -(-tokens // capacity) * 1.02 + 1
    assert packing.pack_documents(docs.limit(0), PATH, capacity).collect() == []


def histogram(sizes, capacity):
    return np.bincount(np.array(sizes, np.int64), minlength=capacity + 1)


def optimum(sizes, capacity):
    """Exact, by search: the longest piece goes into every different gap or a new sequence."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def search(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(sizes):
            best = len(gaps)
            return
        for gap in set(gaps):
            if gap >= sizes[i]:
                rest = list(gaps)
                rest.remove(gap)
                search(i + 1, rest + [gap - sizes[i]])
        search(i + 1, gaps + [capacity - sizes[i]])

    search(0, [])
    return best


def total(patterns, capacity):
    held = np.zeros(capacity + 1, np.int64)
    for runs, count in patterns:
        assert count > 0 and sum(s * n for s, n in runs) <= capacity
        for size, often in runs:
            held[size] += often * count
    return held


@settings(max_examples=300, deadline=None)
@given(st.integers(5, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_reduction_keeps_the_optimum(case):
    capacity, sizes = case
    counts = histogram(sizes, capacity)
    fixed, rest = packing.reduce_instance(counts)
    assert (total(fixed, capacity) + rest == counts).all()
    left = [s for s in range(capacity + 1) for _ in range(rest[s])]
    assert sum(p.count for p in fixed) + (optimum(left, capacity) if left else 0) == (optimum(sizes, capacity) if sizes else 0)


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_best_fit_equals_piece_by_piece(case):
    capacity, sizes = case
    plan = packing.best_fit(histogram(sizes, capacity))
    assert (total(plan, capacity) == histogram(sizes, capacity)).all()
    gaps = []
    for size in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - size)
        else:
            gaps.append(capacity - size)
    found = [capacity - sum(s * n for s, n in p.runs) for p in plan for _ in range(p.count)]
    assert sorted(found) == sorted(gaps)


def test_plan_follows_the_capacity_and_not_the_pieces():
    rng = np.random.default_rng(8)
    counts = np.zeros(2049, np.int64)
    counts[1:] = rng.integers(0, 50, 2048)
    small, large = packing.packing_plan(counts), packing.packing_plan(counts * 1_000_000)
    assert len(large) < 20 * len(small)
    assert (total(large, 2048) == counts * 1_000_000).all()
    tokens = int((counts * np.arange(2049)).sum()) * 1_000_000
    assert sum(p.count for p in large) <= 1.01 * tokens / 2048


def test_long_texts_get_the_tokenizers_ids():
    encode, tokenizer = packing.encoder(PATH), Tokenizer.from_file(PATH)
    for text in TEXTS[1:]:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
