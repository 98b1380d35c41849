"""Spans of secrets against plain loops over characters."""

import math
import random
import re
from collections import Counter

import pytest

from lineloom.llm import secret_scan
from lineloom.llm.secret_scan import CANDIDATE, CLASSES, NAMES, find_secrets, secret_report

RANDOM = "q7Zt0LpX4vRb9KcW2mHs8JdY"


def entropy(part):
    return -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values())


def plain(text):
    """``kind:start:end`` of all spans, one regular expression at a time."""
    text = text or ""
    kinds = ((secret_scan.ASSIGN, 2, 12), (secret_scan.ACCESS, 0, 0), (secret_scan.HEX, 0, 0))
    spans, rest = [], text
    for rank, (pattern, group, least) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                spans.append((m.start(), rank, m.end()))
        rest = re.sub(pattern, lambda m: " " * len(m[0]) if len(m[group]) >= least else m[0], rest)
    base = len(spans)
    for pattern in secret_scan.ALLOWED:
        rest = re.sub(pattern, lambda m: " " * len(m[0]), rest)
    for m in re.finditer(CANDIDATE, rest):
        run = m[0]
        if not re.search("[0-9]", run) or re.search(NAMES, run):
            continue
        kind = next(c for c in CLASSES if re.search(c.pattern, run))
        windows = [entropy(run[i:i + kind.window]) for i in range(len(run) - kind.window + 1)]
        if max(windows, default=-1) >= kind.threshold - 1e-12:
            spans.append((m.start(), 3, m.end()))
    names = secret_scan.KINDS
    return ",".join(f"{names[r]}:{a}:{b}" for a, r, b in sorted(spans)), base


def pieces():
    rng = random.Random(11)
    alphabet = "abcdefABCXYZ0123456789+/_=-"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    made += ["".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(12, 40))) for _ in range(20)]
    fixed = ["password: ", "token=", "api_key = '", "AKIA", "AKIA" + "Z9" * 7, "A" * 7, "/sample/keys/", "example", " ", "\n", " é ", "", "中",
             "/", RANDOM, "release-notes-for-users-2024", "1" * 30, "12345678901234567890", "secret=short ", "deadbeef" * 3]
    return made + fixed * 3


def test_spans_equal_plain_loops(spark):
    rng = random.Random(12)
    parts = pieces()
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += [None, "", " ".join(parts) * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: (r.spans, r.n_assign + r.n_access + r.n_hex) for r in secret_report(find_secrets(df)).collect()}
    for i, text in enumerate(texts):
        assert found[i] == plain(text), text
    assert sum("entropy" in spans for spans, _ in found.values()) > 100


@pytest.mark.parametrize("before", ["/sample/keys/", "0123456789abcdef01234567/", "AAAAAA", "password=abcdefghijkl "])
def test_random_part_is_found_beside_known_parts(spark, before):
    df = spark.createDataFrame([(1, f"see {before}{RANDOM} here")], "doc_id bigint, text string")
    spans = secret_report(find_secrets(df)).first().spans.split(",")
    last = spans[-1].split(":")
    assert last[0] == "entropy" and int(last[2]) == 4 + len(before) + len(RANDOM)


def test_names_and_placeholders_are_no_secrets(spark):
    texts = ["release-notes-for-users-2024", "EXAMPLE-changeme-123-dummy-77", "g7" + "G" * 40, f"example{RANDOM}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.spans for r in secret_report(find_secrets(df)).collect()} == {""}


def test_many_matches_in_one_text(spark):
    one = "deadbeefdeadbeef "
    df = spark.createDataFrame([(1, one * 30_001)], "doc_id bigint, text string")
    row = find_secrets(df).select("base", "extra").first()
    assert [(s.start, s.stop) for s in row.base] == [(17 * i, 17 * i + 16) for i in range(30_001)] and row.extra == []
