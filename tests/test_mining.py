import pytest
from pyspark.sql import functions as F

import brute
from lineloom.functions.masking import SEP
from lineloom.operators.matching import match_templates
from lineloom.operators.mining import (
    assign_templates, mine_templates, mined_template_counts, template_counts,
)
from lineloom.operators.parameters import extract_parameters
from lineloom.plans import joins
from lineloom.plans.parse import parse_messages
from lineloom.sources.lines import load_log
from lineloom.plans.presets import Preset


def as_lines(spark, messages):
    rows = [(line, str(len(tokens)), SEP.join(tokens)) for line, tokens in messages]
    return spark.createDataFrame(rows, "LineId bigint, Bucket string, Signature string").repartition(3)


def result(spark, messages, **options):
    lines = as_lines(spark, messages)
    mining = mine_templates(lines, **options)
    text = {r.LineId: r.EventTemplate for r in assign_templates(lines, mining).collect()}
    return text, mining


def expected(messages, algorithm, method, st, n=3):
    home, clusters = algorithm(messages, method, st, n)
    return {line: "".join(clusters[home[line]]) for line, _ in messages}


@pytest.fixture
def tight_limits(monkeypatch):
    """Every key is hot and nothing fits a broadcast."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins.hot_keys, "__defaults__", (1,))
    original = joins.hot_keys
    monkeypatch.setattr(joins, "hot_keys", lambda counts, keys, weight, hot_rows=1: original(counts, keys, weight, 1))


@pytest.mark.parametrize("method,window", [("seqDist", 10_000), ("seqDist", 40), ("combined", 90)])
def test_sequential_equals_one_pass(spark, method, window):
    messages = brute.random_messages(1, 160)
    text, _ = result(spark, messages, method=method, st=0.7, mode="sequential", window=window)
    assert text == expected(messages, brute.sequential, method, 0.7)


def test_sequential_continues_from_known_templates(spark):
    messages = brute.random_messages(2, 120)
    half = as_lines(spark, messages[:60])
    first = mine_templates(half, "seqDist", 0.7, mode="sequential")
    rest = as_lines(spark, messages[60:])
    known = first.clusters.select("Bucket", "ClusterId", "Tokens")
    second = mine_templates(rest, "seqDist", 0.7, mode="sequential", window=60, known=known)
    text = {r.LineId: r.EventTemplate for r in assign_templates(rest, second).collect()}
    whole = expected(messages, brute.sequential, "seqDist", 0.7)
    assert text == {line: whole[line] for line, _ in messages[60:]}


@pytest.mark.parametrize("method,st", [("seqDist", 0.7), ("jaccard", 0.6), ("ngram", 0.5), ("combined", 0.8)])
def test_leader_equals_one_pass(spark, method, st):
    messages = brute.random_messages(4, 200)
    text, mining = result(spark, messages, method=method, st=st)
    want = expected(messages, brute.leader, method, st)
    assert text == want
    counts = {r.EventTemplate: r.Occurrences for r in mined_template_counts(mining).collect()}
    assert counts == {t: list(want.values()).count(t) for t in set(want.values())}


def test_leader_with_hot_keys_and_no_broadcast(spark, tight_limits):
    messages = brute.random_messages(7, 200)
    text, _ = result(spark, messages, method="seqDist", st=0.7)
    assert text == expected(messages, brute.leader, "seqDist", 0.7)


def test_many_leader_rounds(spark, monkeypatch):
    monkeypatch.setattr("lineloom.operators.earliest.FIRST_HEADS", 1)
    messages = brute.random_messages(8, 80)
    text, _ = result(spark, messages, method="seqDist", st=0.9)
    assert text == expected(messages, brute.leader, "seqDist", 0.9)


def test_refined_templates_cover_the_first_ones(spark):
    messages = brute.random_messages(9, 150)
    once, _ = result(spark, messages, method="seqDist", st=0.7)
    twice, _ = result(spark, messages, method="seqDist", st=0.7, refine=True)
    assert set(twice) == set(once)
    assert len(set(twice.values())) <= len(set(once.values()))


def test_newest_delimiter_outlives_a_mismatch(spark):
    messages = [(1, ["x", " ", "x", " ", "y"]), (2, ["(", " ", "x", " ", "y"])]
    for mode in ("leader", "sequential"):
        text, _ = result(spark, messages, method="seqDist", st=0.5, mode=mode)
        assert set(text.values()) == {"( x y"}


def test_empty_messages_share_an_event(spark):
    messages = [(1, []), (2, ["a"]), (3, [])]
    for mode in ("leader", "sequential"):
        lines = spark.createDataFrame(
            [(1, "0", ""), (2, "1", "a"), (3, "0", "")], "LineId bigint, Bucket string, Signature string"
        )
        mining = mine_templates(lines, "seqDist", 0.5, mode=mode)
        got = {r.LineId: r.EventId for r in assign_templates(lines, mining).collect()}
        assert got[1] == got[3] == "d41d8cd9" and got[2] != got[1], messages


def test_match_templates(spark, tight_limits):
    known = [(1, ["a", " ", "<*>"]), (2, ["a", " ", "b"]), (3, ["a", " ", "b"])]
    templates = spark.createDataFrame(
        [(str(len(t)), i, t) for i, t in known], "Bucket string, ClusterId bigint, Tokens array<string>"
    )
    lines = as_lines(spark, [(1, ["a", " ", "b"]), (2, ["a", " ", "c"]), (3, ["q", "r", "s"]), (4, ["a"])])
    got = {r.LineId: (r.ClusterId, r.Score) for r in match_templates(lines, templates, 0.6).collect()}
    assert got[1] == (2, 1.0)  # the older of two equal templates
    assert got[2] == (1, pytest.approx(2 / 3))
    assert got[3] == got[4] == (None, None)


def test_template_counts_in_order_of_appearance(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, "c")], "LineId bigint, EventTemplate string")
    rows = template_counts(df, ordered=True).collect()
    assert [(r.EventTemplate, r.Occurrences) for r in rows] == [("a", 1), ("b", 2), ("c", 1)]


def test_parameters(spark):
    rows = [
        ("copy a b done", "copy <*> <*> done", ["a b"], ["a", "b"]),
        ("send 5 to h1 ok", "send <*> to <*> ok", ["5", "h1"], ["5", "h1"]),
        ("no match", "send <*>", [], []),
        ("plain", "plain", [], []),
        ("a.b  (7)", "a.b <*>", ["(7)"], ["(7)"]),
        ("x <ok> y", "x <ok> y", ["<ok>"], []),
        ("a\u0001b c", "<*> c", ["a\u0001b"], ["a\u0001b"]),
        ("cost $1 \\ 2", "cost <*> \\ <*>", ["$1", "2"], ["$1", "2"]),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "Content string, EventTemplate string")
    got = {r.Content: r.ParameterList for r in extract_parameters(df).collect()}
    assert got == {r[0]: r[2] for r in rows}
    got = {r.Content: r.ParameterList for r in extract_parameters(df, collapse_wildcards=False).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_parse_does_not_depend_on_row_order(spark):
    contents = [f"disk {i % 7} at node n{i % 3} failed with {i}" for i in range(90)] + ["all good"] * 10
    preset = Preset("", st=0.5, method="seqDist")
    df = spark.createDataFrame(list(enumerate(contents)), "LineId bigint, Content string")

    def run(source):
        parsed = parse_messages(source, preset)
        return (
            {r.LineId: (r.EventTemplate, tuple(r.ParameterList)) for r in parsed.structured.collect()},
            {r.EventTemplate: r.Occurrences for r in parsed.templates.collect()},
        )

    one, other = run(df.coalesce(1)), run(df.orderBy(F.rand(5)).repartition(5))
    assert one == other
    assert one[1] == {"disk <*> at node <*> failed with <*>": 90, "all good": 10}
    assert one[0][0][1] == ("0", "n0", "0")


def test_two_files_whose_line_numbers_meet(spark, tmp_path):
    (tmp_path / "a.log").write_text("I: alpha beta 1 2\nI: one two three four\n")
    (tmp_path / "b.log").write_text("I: one two three 5\nI: alpha beta 3 4\nI: one two three 6\n")
    messages = load_log(spark, str(tmp_path), "<Level>: <Content>")
    parsed = parse_messages(messages, Preset("", st=0.6, method="seqDist"))
    rows = sorted((r.SourceFile[-5:], r.LineId, r.EventTemplate) for r in parsed.structured.collect())
    assert [r[:2] for r in rows] == [("a.log", 1), ("a.log", 2), ("b.log", 1), ("b.log", 2), ("b.log", 3)]
    assert len(set(r[2] for r in rows)) == 2
    assert sorted(r.Occurrences for r in parsed.templates.collect()) == [2, 3]


def test_rounds_leave_no_tables_behind(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("lineloom.operators.earliest.FIRST_HEADS", 4)
    monkeypatch.setattr("lineloom.operators.candidates.DIRECT", 0)
    monkeypatch.setattr("lineloom.workspace.shared_dir", lambda spark: str(tmp_path))
    messages = brute.random_messages(10, 120)
    text, mining = result(spark, messages, method="seqDist", st=0.8)
    assert text == expected(messages, brute.leader, "seqDist", 0.8)
    left = {path.name.split("-", 1)[1] for path in tmp_path.glob("lineloom-*/*")}
    assert left == {"members", "rendered", "labelled"}
    # members hold a message once: its tokens are cut from it when they are needed
    assert "Tokens" not in spark.read.parquet(str(next(tmp_path.glob("*/*-members")))).columns
