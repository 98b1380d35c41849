import random

import pytest
from pyspark.sql import functions as F

import brute
from lineloom.operators import evaluation
from lineloom.plans import benchmark
from lineloom.plans.benchmark import Labelled, benchmark_suite
from lineloom.plans.presets import Preset


def tables(spark, truth, parsed):
    schema = "LineId bigint, EventTemplate string"
    rows = [list(enumerate(side)) for side in (truth, parsed)]
    random.Random(1).shuffle(rows[1])
    return spark.createDataFrame(rows[0], schema), spark.createDataFrame(rows[1], schema)


def metrics(spark, truth, parsed, wanted=None):
    pairs = evaluation.template_pairs(*tables(spark, truth, parsed)).cache()
    group = evaluation.grouping_accuracy(pairs, wanted).first().asDict()
    return group | evaluation.template_accuracy(pairs, wanted).first().asDict()


@pytest.mark.parametrize(
    "truth,parsed,want",
    [
        ("aabc", "aabc", dict(GA=1, FGA=1, PTA=1, RTA=1, FTA=1)),
        ("aab", "aaa", dict(GA=0, FGA=0, PTA=0, RTA=0, FTA=0)),
        ("aabc", "aaxx", dict(GA=0.5, PGA=1 / 2, RGA=1 / 3, FGA=0.4, PTA=1 / 2, RTA=1 / 3, FTA=0.4)),
    ],
)
def test_hand_cases(spark, truth, parsed, want):
    got = metrics(spark, list(truth), list(parsed))
    for name, value in want.items():
        assert got[name] == pytest.approx(value), name


@pytest.mark.parametrize("seed", range(4))
def test_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    truth = [rng.choice(["a", "b", "c", "d", "e", None]) for _ in range(40)]
    parsed = [
        t if t in ("a", "b") and rng.random() < 0.97 else rng.choice(["c", "d", "x", None]) for t in truth
    ]
    for wanted in (None, ["a", "c", "zz"], ["b", "d"]):
        got, want = metrics(spark, truth, parsed, wanted), brute.group_metrics(truth, parsed, wanted)
        for name, value in want.items():
            assert got[name] == pytest.approx(value), (name, wanted)


def test_missing_parse_may_balance_sizes(spark):
    # label "a" has three lines, one of them unparsed; "p" has three lines, one of them labelled "b"
    truth, parsed = ["a", "a", "a", "b"], ["p", "p", None, "p"]
    assert metrics(spark, truth, parsed)["GA"] == brute.group_metrics(truth, parsed)["GA"] == 0.75


def test_filter_as_table(spark):
    truth, parsed = list("aabbc"), list("aaxxc")
    wanted = spark.createDataFrame([("a",), ("b",)], "t string")
    assert metrics(spark, truth, parsed, wanted) == metrics(spark, truth, parsed, ["a", "b"])


def test_parsing_accuracies(spark):
    pairs = evaluation.template_pairs(
        *tables(spark, ["x <*>y", "b", "c", None], ["x <*>", "b", None, "q"])
    )
    assert evaluation.parsing_accuracy(pairs).first().PA == pytest.approx(1 / 3)
    assert evaluation.parsing_accuracy_lenient(pairs).first().PA == pytest.approx(2 / 3)
    assert evaluation.exact_match_accuracy(pairs).first().ExactMatch == pytest.approx(1 / 3)
    assert evaluation.parsing_accuracy(pairs, ["b"]).first().PA == 1.0


def test_evaluate_rows(spark):
    row = evaluation.evaluate_full(*tables(spark, list("aabc"), list("aaxx"))).first()
    assert row.asDict() == pytest.approx(
        dict(GA=0.5, PA=0.5, FGA=0.4, FTA=0.4, PTA=0.5, RTA=1 / 3)
    )
    assert evaluation.evaluate(*tables(spark, list("ab"), list("ab"))).columns == ["GA", "FGA", "FTA", "PTA", "RTA"]


def test_benchmark_suite(spark):
    contents = [f"job {i} done" for i in range(20)] + [f"link {i} is down" for i in range(20)]
    messages = spark.createDataFrame(list(enumerate(contents)), "LineId bigint, Content string")
    truth = messages.selectExpr("LineId", "regexp_replace(Content, '[0-9]+', '<*>') as EventTemplate")
    rows = benchmark_suite({"one": Labelled(messages, truth, Preset("", st=0.5, method="seqDist"))}).collect()
    assert [r.Dataset for r in rows] == ["one", "Average"]
    assert all(r.GA == r.FGA == r.FTA == 1.0 and r.P_Time > 0 for r in rows)


def test_one_log_under_two_labels_is_parsed_once(spark, monkeypatch):
    parses = []
    whole = benchmark.parse_messages
    monkeypatch.setattr(benchmark, "parse_messages", lambda *args: parses.append(1) or whole(*args))
    log = spark.createDataFrame([(1, "a 1"), (2, "a 2")], "LineId bigint, Content string")
    right = spark.createDataFrame([(1, "a <*>"), (2, "a <*>")], "LineId bigint, EventTemplate string")
    preset = Preset("", st=0.5, method="seqDist")
    wrong = right.withColumn("EventTemplate", F.concat("EventTemplate", F.col("LineId").cast("string")))
    suite = {name: benchmark.Labelled(log, truth, preset) for name, truth in (("right", right), ("wrong", wrong))}
    got = {r.Dataset: r.PTA for r in benchmark.benchmark_suite(suite).collect()}
    assert got == {"right": 1.0, "wrong": 0.0, "Average": 0.5} and len(parses) == 1
