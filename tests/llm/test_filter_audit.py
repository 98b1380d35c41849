"""The filter audit against a loop over all orders and documents."""

import itertools
import re

import numpy as np
import pytest

from lineloom.llm import filter_audit

DOCS = "doc_id bigint, text string, source string, part string, label int, fails int"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def documents():
    rng = np.random.default_rng(5)
    texts = [None, "", "  ", "one # two", "ABC DEF", " ".join(f"w{i}" for i in range(60)), " ".join(["same"] * 80)]
    texts += [" ".join(f"W{i}" for i in range(55)), " ".join(f"é{i} |" for i in range(70)), " ".join(["x"] * 60000)]
    for _ in range(60):
        words = [f"w{rng.integers(0, 90)}" for _ in range(rng.integers(30, 90))]
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words.append("$")
        texts.append(" ".join(words))
    rows = [(i, t, ("s0", "s1", None, "")[i % 4], "p", 7, 7) for i, t in enumerate(texts)]
    rows += [(200 + i, texts[5 + i % 9], "s0", None, None, None) for i in range(40)]
    return rows + rows[8:12] + [(None, texts[5], "s1", None, 1, 1), (None, texts[5], "s1", None, 1, 1), (3, "another text", "s1", None, 0, 0)]


def labels():
    rows = [(i, int(i % 3 == 0), int(i % 5 == 0), "p") for i in range(0, 240, 2)]
    return rows + [(2, 1, 1, None), (2, 0, None, None), (None, 1, 1, None)]


def brute(docs, marks):
    good, toxic = {d for d, q, _, _ in marks if q == 1 and d is not None}, {d for d, _, t, _ in marks if t == 1 and d is not None}
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    judged = []
    for d, t, source, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and d > least[t],
        }
        judged.append((source or "", {f for f, bad in fails.items() if bad}, d in good, d in toxic))
    out, shapley = {}, {}
    for part in {j[0] for j in judged}:
        mine = [j[1:] for j in judged if j[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                earlier = set(order[:step - 1])
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x[0] and bool(earlier & x[0]) for x in mine), sum(x[0] == {f} for x in mine),
                    sum(x[1] for x in gone), sum(x[2] for x in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_rows(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in df.collect()}


def test_against_every_order(spark):
    docs = spark.createDataFrame(documents(), DOCS).repartition(5)
    marks = spark.createDataFrame(labels(), LABELS)
    found = as_rows(filter_audit.audit_filters(docs, marks))
    assert found == brute(documents(), labels())
    assert len(found) == 3 * 600


def test_many_parts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "MOST_KEYS", 3)
    rows = [(i, f"text {i // 2}", f"s{i % 11}", None, None, None) for i in range(150)]
    none = spark.createDataFrame([], LABELS)
    assert as_rows(filter_audit.audit_filters(spark.createDataFrame(rows, DOCS), none)) == brute(rows, [])
    assert filter_audit.audit_filters(spark.createDataFrame([], DOCS), none).collect() == []


@pytest.mark.parametrize("count", [0, 1, 2, 3, 7, 1000])
def test_carry_save_counts(count):
    words = np.random.default_rng(count).integers(0, 2**32, count, dtype=np.uint32)
    counter = filter_audit.BitCounter()
    for part in np.array_split(words, 4):
        counter.add(part)
    assert counter.counts() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]
    assert all(len(w) <= 2 for w in counter.weights)
