"""Conversation repair against an exhaustive search (short) and a program over whole strings (long)."""

import hashlib
import itertools
import re
import zlib

import numpy as np

from lineloom.llm import conversation_repair
from lineloom.llm.conversation_repair import damage, plan_repairs, repair_report

SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind string, audit string, digest string"
PATTERN = re.compile(r"(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def faults(rows):
    """Rows are (turn, role, text) in order; each gets its initial, whether it must go, whether it is cut off."""
    seen, out, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        kept = text.rstrip(" \t\n\x0b\x0c\r")
        blank, again = not kept, (role, text) in seen
        cut = not blank and not again and kept[-1] not in ".!?"
        seen.add((role, text))
        for i, fault in enumerate((blank, again and not blank, cut)):
            counts[i] += fault
        out.append((role[:1], blank or again, cut))
    return counts, out


def search(rows, judged):
    """Every way to edit a few rows."""
    best = None
    between = [""] + ["".join(p) for n in (1, 2) for p in itertools.product("ua", repeat=n)]
    ways = [["D"] + ([] if gone else ["u", "a"] + ["K"] * bool(initial)) for initial, gone, _ in judged]
    for edits in itertools.product(*ways):
        for gaps in itertools.product(between, repeat=len(rows) + 1):
            roles, audit, cost, turns = "", "", 0, []
            for i, gap in enumerate(gaps):
                roles, audit, cost = roles + gap, audit + "I" * len(gap), cost + 2 * len(gap)
                turns += [NAMES[g] + ":" for g in gap]
                if i < len(rows):
                    edit, (initial, _, cut) = edits[i], judged[i]
                    audit += edit if edit in "DK" else "R"
                    if edit == "D":
                        cost += 3
                        continue
                    roles += initial if edit == "K" else edit
                    cost += cut + (0 if edit == "K" else 2)
                    turns.append(f"{rows[i][1] if edit == 'K' else NAMES[edit]}:{rows[i][2]}")
            if PATTERN.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, turns
    return best


def program(rows, judged):
    """The least (cost, letters) for each end of the role string, with all turns."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    states = {"": (0, "", [])}

    for (turn, role, text), (initial, gone, cut) in zip(rows, judged):
        # all ways in, not only the best: an insertion before the row changes the letters
        ways = [(at, *w) for at, w in states.items()]
        for _ in range(2):
            ways += [(x, c + 2, a + "I", t + [NAMES[x] + ":"]) for at, c, a, t in ways for x in follow[at] if x in NAMES]
        after: dict = {}
        for at, cost, audit, turns in ways:
            nexts = [(at, cost + 3, audit + "D", turns)]
            if not gone:
                if initial and initial in follow[at]:
                    nexts.append((initial, cost + cut, audit + "K", turns + [f"{role}:{text}"]))
                nexts += [(x, cost + 2 + cut, audit + "R", turns + [f"{NAMES[x]}:{text}"]) for x in follow[at] if x in NAMES]
            for to, *way in nexts:
                if to not in after or tuple(way[:2]) < tuple(after[to][:2]):
                    after[to] = way
        states = {k: tuple(v) for k, v in after.items()}
    ends = [(at, *w) for at, w in states.items()]
    for _ in range(2):
        ends += [(x, c + 2, a + "I", t + [NAMES[x] + ":"]) for at, c, a, t in ends for x in follow[at] if x in NAMES]
    return min((e[1:] for e in ends if e[0] in ("", "a")), key=lambda e: e[:2])


def wanted(rows, find=program):
    counts, judged = faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[0] + b[0] if a[0] and b[0] else "" for a, b in itertools.pairwise(judged)]
    cost, audit, repaired = find(rows, judged)
    sha = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
    return gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha


def table(spark, conversations):
    rows = [(c, t, r, x, "k", "a", "d") for c, turns in conversations.items() for t, r, x in turns]
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(rng, count, roles=("user", "assistant", "system", "tool", "", "u2")):
    texts = ["done.", "why?", "cut", " ", "", "no!\t ", "x"]
    turns = sorted(rng.choice(4 * count + 4, count, replace=False).tolist())
    return [(t, str(rng.choice(roles)), str(rng.choice(texts)) if rng.random() < 0.5 else f"t{t}.") for t in turns]


def found(df):
    return {r.conv_id: tuple(r[c] for c in REPORT) for r in df.collect()}


def test_short_conversations_exhaustively(spark):
    rng = np.random.default_rng(3)
    conversations = {i: random_rows(rng, 1 + i % 3) for i in range(60)}
    want = {c: wanted(rows, search) for c, rows in conversations.items()}
    assert {c: wanted(rows) for c, rows in conversations.items()} == want
    assert found(repair_report(table(spark, conversations).repartition(4))) == want


def test_long_conversations_over_many_batches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(conversation_repair, "BLOCK", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        conversations = {i: random_rows(rng, 80) for i in range(12)}
        conversations[50] = [(t, "user", f"question {t}?") for t in range(300)]
        conversations[51] = [(t, "assistant", "the same.") for t in range(150)]
        conversations[52] = [(t, ("assistant", "user")[t % 2], f"cut {t % 20}") for t in range(200)]
        got = found(repair_report(table(spark, conversations).repartition(3)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {c: wanted(rows) for c, rows in conversations.items()}


def test_nulls_repeated_rows_and_empty_tables(spark):
    conversations = {
        None: [(None, "user", "hello."), (5, "assistant", "there.")],
        1: [(None, None, None), (3, "user", None), (9, "user", "why?")],
        2: [(1, "user", "again."), (1, "user", "again."), (1, "user", "again."), (2, "assistant", "again.")],
        3: [(2**60, "system", "big."), (2**60 + 2, "user", "bigger.")],
    }
    want = {c: wanted([(t, r or " ", " " if x is None else x) for t, r, x in rows]) for c, rows in conversations.items()}
    assert found(repair_report(table(spark, conversations))) == want
    assert repair_report(spark.createDataFrame([], SCHEMA)).collect() == []


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        told = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(told).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [row] * (2 if kind == 3 else 1)
    return out


def test_damaged_conversations(spark):
    rng = np.random.default_rng(6)
    conversations = {i: random_rows(rng, 1 + int(rng.integers(0, 30)), ("user", "assistant")) for i in range(80)}
    conversations |= {c: [(0, "user", "hello.")] for c in range(200, 300)}
    want = {c: wanted(damaged([(c, *r) for r in rows])) for c, rows in conversations.items()}
    assert any(not damaged([(c, *r) for r in rows]) for c, rows in conversations.items())
    assert found(repair_report(damage(table(spark, conversations)))) == want


def test_plan_needs_no_copy_column(spark):
    plan = plan_repairs(table(spark, {1: [(0, "assistant", "hi."), (1, "assistant", "cut")]})).collect()
    assert [(r.conv_id, r.cost, r.audit) for r in plan] == [(1, *wanted([(0, "assistant", "hi."), (1, "assistant", "cut")])[5:7])]
