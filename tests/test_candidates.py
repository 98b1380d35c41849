"""The index of rare tokens loses no pair and reads far fewer than all."""

import random

import pytest
from pyspark.sql import functions as F

from lineloom.functions.similarity import pair_similarity
from lineloom.operators import candidates, positional
from lineloom.operators.matching import similar_pairs
from lineloom.workspace import Workspace

SCHEMA = "Bucket string, {0} bigint, Tokens array<string>"


def sequences(seed, count, wildcards):
    rng = random.Random(seed)
    out = [[], [], ["<*>", "<*>"]]
    for _ in range(count):
        size = rng.choice([1, 2, 5, 5, 9])
        tokens = [rng.choice(["a", "b", "c", f"t{rng.randrange(30)}"]) for _ in range(size)]
        out.append(["<*>" if wildcards and rng.random() < 0.2 else t for t in tokens])
    return out


def tables(spark, many, few):
    rows = [[(str(len(t)), i, t) for i, t in enumerate(side)] for side in (many, few)]
    return (
        spark.createDataFrame(rows[0], SCHEMA.format("First")).repartition(3),
        spark.createDataFrame(rows[1], SCHEMA.format("ClusterId")),
    )


@pytest.mark.parametrize("method", ["seqDist", "jaccard"])
@pytest.mark.parametrize("st", [0.3, 0.5, 1.0])
def test_every_similar_pair_is_found(spark, monkeypatch, method, st):
    monkeypatch.setattr(candidates, "DIRECT", 0)
    many, few = sequences(1, 150, False) + [["<*>", "a"]], sequences(2, 60, True)
    left, right = tables(spark, many, few)
    earlier = F.col("few.ClusterId") < F.col("many.First")
    found = {(r.First, r.ClusterId): r.Score for r in similar_pairs(left, right, method, st, 3, earlier).collect()}
    want = {}
    for i, m in enumerate(many):
        for j, t in enumerate(few):
            if j < i and len(m) == len(t):
                score = 1.0 if not t else pair_similarity(tuple(t), tuple(m), method, 3)
                if score >= st:
                    want[i, j] = pytest.approx(score)
    assert found == want


def test_candidates_follow_rare_tokens(spark):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(20000)]
    many, few = ([[rng.choice(words) for _ in range(8)] for _ in range(candidates.DIRECT + 100)] for _ in range(2))
    left, right = tables(spark, many, few)
    assert candidates.use_index(right, "seqDist", 0.6)
    assert not candidates.use_index(right, "ngram", 0.6) and not candidates.use_index(right, "seqDist", 0.0)
    assert candidates.candidate_pairs(left, right, "seqDist", 0.6, Workspace(spark)).count() < len(many) * len(few) / 5


@pytest.mark.parametrize("method", ["seqDist", "jaccard"])
@pytest.mark.parametrize("st", [0.2, 0.5, 0.9])
def test_blanks_come_last_and_lose_no_pair(spark, monkeypatch, method, st):
    monkeypatch.setattr(candidates, "DIRECT", 0)
    spaced = lambda rows: [" \u0001".join(f"{t}\u0001" for t in row).rstrip("\u0001").split("\u0001") for row in rows if row]
    many, few = spaced(sequences(5, 120, False)), spaced(sequences(6, 60, True)) + [["a", "  ", " "], [" ", " ", " "]]
    many += [[" ", " ", " "], ["b", " ", " "]]
    left, right = tables(spark, many, few)
    found = {(r.First, r.ClusterId) for r in similar_pairs(left, right, method, st, 3).collect()}
    want = {
        (i, j) for i, m in enumerate(many) for j, t in enumerate(few)
        if len(m) == len(t) and pair_similarity(tuple(t), tuple(m), method, 3) >= st
    }
    assert found == want
    if st == 0.5:  # a prefix that ends before the blanks asks for none
        first = candidates._items(left.where(F.array_contains("Tokens", "a")), "First", "seqDist", st)
        assert first.where("Blank AND Prefix <= Size").isEmpty()


@pytest.mark.parametrize("st", [0.2, 0.5, 0.9, 1.0])
def test_positional_pairs_are_the_compared_ones(spark, monkeypatch, st):
    """Groups of buckets held by every task give the pairs of a plain comparison, with their scores."""
    monkeypatch.setattr(positional, "LEAST", 0)
    monkeypatch.setattr(positional, "MOST_TOKENS", 60)
    monkeypatch.setattr(positional, "_STEP", 7)
    rng = random.Random(7)

    def side(count, key):
        rows = [[rng.choice(["a", "b", " ", "  ", "<*>", f"c{rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 4))] for _ in range(count)]
        return [(str(len(x)), i, "\u0001".join(x)) for i, x in enumerate(rows)], f"Bucket string, {key} bigint, Signature string"

    many, few = side(60, "First"), side(40, "ClusterId")
    left, right = spark.createDataFrame(*many), spark.createDataFrame(*few)
    groups = positional.task_groups(right, st)
    assert len(groups) > 1 and sorted(b for g in groups for b in g) == sorted({b for b, _, _ in few[0]})
    found = [(r.First, r.ClusterId, r.Score) for r in positional.positional_pairs(left, right, groups, st, earlier=True).collect()]
    want = set()
    for bucket, first, message in many[0]:
        for other, cluster, template in few[0]:
            tokens = list(zip(template.split("\u0001"), message.split("\u0001"))) if template else []
            score = sum(t == m and t != "<*>" for t, m in tokens) / len(tokens) if tokens else 1.0
            if bucket == other and cluster < first and score >= st:
                want.add((first, cluster, score))
    assert set(found) == want and len(found) == len(want) > 20


def test_differing_places_come_once(spark):
    rows = [(1, "a\u0001b\u0001c", "a\u0001x\u0001c"), (1, "a\u0001b\u0001c", "a\u0001y\u0001d"), (2, "", ""), (3, "a", "a"), (4, "p\u0001q", "r\u0001s")]
    pairs = spark.createDataFrame(rows, "ClusterId bigint, Lead string, Signature string").coalesce(1)
    found = [(r.ClusterId, r.Pos) for r in positional.differing_places(pairs).collect()]
    assert sorted(found) == [(1, 1), (1, 2), (4, 0), (4, 1)]
