"""Nearest vectors of any magnitude, and of unequal lengths, against a loop in exact fractions."""

import math
from fractions import Fraction

import pytest

from lineloom.llm import vector_search

SCHEMA = "vec_id bigint, embedding array<double>, score double, list int"
VECTORS = [
    (0, [2.0**-660, 2.0**-659]), (1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [2.0**660, 2.0**661]), (4, [-1.0, 0.5]), (5, [1.0]), (6, [3.0, 2.0, 1.0]),
    (7, [5e-324, 0.0]), (8, [1.7e308, 1.7e308]), (9, None), (10, [0.0, 0.0]), (11, [float("nan"), 1.0]),
]


def cosine(a, b):
    a, b = ([Fraction(x) / max(map(abs, map(Fraction, v))) for x in v] for v in (a, b))
    dot, lengths = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) * sum(y * y for y in b)
    return math.copysign(math.sqrt(dot * dot / lengths), dot)


def test_every_magnitude(spark):
    rows = spark.createDataFrame([(i, v, 1.0, 2) for i, v in VECTORS], SCHEMA)
    own = [(i, v) for i, v in VECTORS if v and len(v) == 2 and any(v) and not any(map(math.isnan, v))]
    found = {}
    for r in vector_search.nearest_vectors(rows, rows).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i, _ in own}
    for i, v in own:
        want = sorted(((j, cosine(v, w)) for j, w in own if j != i), key=lambda x: (-round(x[1], 12), x[0]))[:5]
        got = sorted(found[i])
        assert [g[1] for g in got] == [w[0] for w in want]
        assert [g[2] for g in got] == [pytest.approx(w[1], abs=1e-12) for w in want]
