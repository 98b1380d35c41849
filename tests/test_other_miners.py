import collections
import random

import pytest
from pyspark.sql import functions as F

from lineloom.operators import earliest, frequent, spell
from lineloom.operators.drain import drain_lines, mine_drain
from lineloom.operators.iplom import mine_iplom
from lineloom.operators.matching import best_pairs
from lineloom.operators.mining import mined_template_counts
from lineloom.operators.slct import mine_slct, slct_outliers
from lineloom.operators.spell import alignment, lcs_length, mine_spell
from lineloom.workspace import Workspace


def messages(spark, contents):
    return spark.createDataFrame(list(enumerate(contents)), "LineId bigint, Content string").repartition(3)


def counts(mining):
    return {r.EventTemplate: r.Occurrences for r in mined_template_counts(mining).collect()}


def test_slct_equals_two_passes(spark):
    rng = random.Random(2)
    rows = [" ".join(rng.choice("aaabbcdefg") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    words = collections.Counter((i, w) for row in rows for i, w in enumerate(row.split()))
    support = 18
    described = collections.Counter()
    for row in rows:
        tokens = [w if words[i, w] > support else "<*>" for i, w in enumerate(row.split())]
        if set(tokens) != {"<*>"}:
            described[" ".join(tokens)] += 1
    mining = mine_slct(messages(spark, rows), support)
    want = {t: n for t, n in described.items() if n > support}
    assert counts(mining) == want and want
    assert slct_outliers(messages(spark, rows), mining).count() == len(rows) - sum(want.values())


def test_slct_combines_covered_templates(spark):
    rows = ["send block 1 now"] * 4 + [f"send block {i} now" for i in range(2, 8)]
    assert counts(mine_slct(messages(spark, rows), 3)) == {"send block 1 now": 4, "send block <*> now": 6}
    assert counts(mine_slct(messages(spark, rows), 3, combine=True)) == {"send block <*> now": 10}


def test_drain_key_and_templates(spark):
    rows = [f"node n{i} is up" for i in range(5)] + [f"disk full at {i}" for i in range(5)] + ["7 a b", "8 a c"]
    keys = {r.Bucket for r in drain_lines(messages(spark, rows), 4).select("Bucket").distinct().collect()}
    assert keys == {"4\u0001node\u0001<*>", "4\u0001disk\u0001full", "3\u0001<*>\u0001a"}
    for mode in ("leader", "sequential"):
        got = counts(mine_drain(messages(spark, rows), 4, 0.5, mode=mode))
        assert got["node <*> is up"] == 5 and got["disk full at <*>"] == 5


def test_iplom_partitions(spark):
    # many users to one word each: too many to be constants, so the other column splits
    rows = [f"user u{i} logs {'in' if i % 2 else 'out'} today" for i in range(60)]
    rows += [f"memory at {i} bytes" for i in range(40)]
    got = counts(mine_iplom(messages(spark, rows)))
    assert got["memory at <*> bytes"] == 40
    assert got["user <*> logs in today"] == 30 and got["user <*> logs out today"] == 30


def test_lcs_helpers():
    rng = random.Random(4)

    def plain(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert lcs_length(a, b) == plain(a, b)
        marks = alignment(a, [rng.randint(0, 3) for _ in a], b)
        assert len(a) - sum(m >= 0 for m in marks) == plain(a, b)
        assert len(set(marks)) == len(marks)


def test_spell_templates(spark):
    rows = [f"job {i} of queue q{i % 4} took {i * 7 % 11} ms" for i in range(40)]
    rows += ["link down", "link eth0 down", "link eth1 vlan 3 down"]
    got = counts(mine_spell(messages(spark, rows), 0.5))
    assert got["job <*> of queue <*> took <*> ms"] == 40
    assert got["link <*> down"] >= 2


@pytest.mark.parametrize("tau,heads", [(0.5, 4), (0.8, 64)])
def test_spell_leaders_equal_a_scan(spark, monkeypatch, tau, heads):
    monkeypatch.setattr(earliest, "FIRST_HEADS", heads)
    rng = random.Random(6)
    words = ["a", "b", "c", "<*>"] + [f"w{i}" for i in range(12)]
    rows = [[rng.choice(words) for _ in range(rng.randint(0, 8))] for _ in range(90)]
    leaders, home = [], {}
    for i, tokens in enumerate(rows):
        scores = [(lcs_length(lead, tokens), -first) for first, lead in leaders]
        score, first = max([s for s in scores if s[0] >= max(1, tau * len(tokens))], default=(0, -i))
        if not score:
            leaders.append((i, tokens))
    for i, tokens in enumerate(rows):  # the best of all earlier leaders
        scores = [(lcs_length(lead, tokens), -first) for first, lead in leaders if first < i]
        home[i] = -max([s for s in scores if s[0] >= max(1, tau * len(tokens))], default=(0, -i))[1]
    sigs = spark.createDataFrame(list(enumerate(rows)), "First bigint, Tokens array<string>").repartition(3)
    ws = Workspace(spark)
    found = spell._leaders(sigs, tau, ws)
    assert sorted(r.ClusterId for r in found.collect()) == [first for first, _ in leaders]
    others = sigs.join(found.select(F.col("ClusterId").alias("First")), "First", "left_anti")
    best = {r.First: r.ClusterId for r in best_pairs(spell._pairs(others, found, tau, ws), "Shared").collect()}
    assert best == {i: h for i, h in home.items() if h != i}


def test_slct_writes_a_message_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("lineloom.workspace.shared_dir", lambda spark: str(tmp_path))
    rows = [f"send block {i} now" for i in range(30)] + ["", "rare words here"]
    df = messages(spark, rows)
    assert counts(mine_slct(df, 20)) == {"send block <*> now": 30}
    tables = {p.name.split("-", 1)[1]: spark.read.parquet(str(p)).columns for p in tmp_path.glob("lineloom-*/*")}
    assert set(tables) == {"distinct-messages", "frequent-words", "described", "candidates", "rendered"}
    assert [name for name, columns in tables.items() if "Signature" in columns] == ["distinct-messages"]
    assert "Tokens" not in tables["distinct-messages"]
    # lines that share a number stay apart
    twice = df.withColumn("LineId", F.col("LineId") % 2)
    assert counts(mine_slct(twice, 20)) == {"send block <*> now": 30}


def test_slct_in_chunks_and_blocks(spark, monkeypatch):
    """Many chunks, blocks and pieces of a message give what one scan gives; lines without a frequent word, and a word that reads as a wildcard."""
    monkeypatch.setattr(frequent, "CHUNK", 40)
    monkeypatch.setattr(frequent, "_PIECE", 3)
    rng = random.Random(5)
    rows = [" ".join(rng.choice(["a", "b", "c", "<*>", f"n{i}"]) for _ in range(rng.choice((1, 2, 9)))) for i in range(600)] + [""] * 3
    rows += ["<*>"] * 40 + ["<*> a"] * 5
    words = collections.Counter((i, w) for row in rows for i, w in enumerate(row.split()))
    support, described = 20, collections.Counter()
    for row in rows:
        if any(words[i, w] > support for i, w in enumerate(row.split())):
            described[" ".join(w if words[i, w] > support else "<*>" for i, w in enumerate(row.split()))] += 1
    want = {t: n for t, n in described.items() if n > support}
    mining = mine_slct(messages(spark, rows), support)
    assert counts(mining) == want and len(want) > 5
    assert slct_outliers(messages(spark, rows), mining).count() == len(rows) - sum(want.values())


def test_slct_asks_for_a_cell_once_a_chunk(spark):
    """A cell that a chunk holds often is one number of its answer, and no row of its own."""
    rows = messages(spark, [f"send block n{i} now" for i in range(500)]).coalesce(1)
    sigs = rows.select(F.replace("Content", F.lit(" "), F.lit("\u0001")).alias("Signature"), F.lit(0).cast("bigint").alias("Chunk"))
    answers = frequent.frequent_numbers(sigs.withColumns({"Size": F.lit(4), "n": F.lit(1).cast("bigint")}), 20).collect()
    assert [(r.Chunk, len(r.Keys)) for r in answers] == [(0, 3 * 8)]


def test_outliers_meet_members_by_a_digest(spark):
    df = messages(spark, [f"send block {i} now" for i in range(30)] + ["rare words here"])
    found = slct_outliers(df, mine_slct(df, 20))
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftAnti" in line]
    assert joins and all("Digest" in line and "Signature" not in line for line in joins)
    assert [r.LineId for r in found.collect()] == [30]
