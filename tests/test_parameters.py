"""Parameters against the lazy pattern that a template stands for."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lineloom.operators.parameters import extract_parameters


def lazy(content, template, collapse):
    if collapse:
        template = re.sub("<.{1,5}>", "<*>", template)
    if "<*>" not in template:
        return []
    parts = [r"\s+".join(map(re.escape, re.split(" +", part))) for part in template.split("<*>")]
    found = re.search("^" + "(.*?)".join(parts) + "$", content)
    return list(found.groups()) if found else []


def extracted(spark, rows, collapse=True):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, Content string, EventTemplate string")
    found = {r.i: r.ParameterList for r in extract_parameters(df.repartition(3), collapse).collect()}
    return [found[i] for i in range(len(rows))]


@pytest.mark.parametrize("collapse", [True, False])
def test_random_templates(spark, collapse):
    rng = random.Random(7)
    rows = []
    for _ in range(8000):
        template = "".join(rng.choice(["a", "b", "<*>", "<*>", " ", "ab", "$", "é"]) for _ in range(rng.randint(1, 8)))
        content = re.sub(" +", " ", "".join(rng.choice(["a", "b", " ", "$", "ab", "é", "\\"]) for _ in range(rng.randint(0, 10))))
        rows.append((content, template))
    assert extracted(spark, rows, collapse) == [lazy(*row, collapse) for row in rows]


def test_runs_of_blanks(spark):
    rows = [
        ("a  b", "a <*> b"), ("a \t x  y   b", "a <*> b"), ("  lead  x", "<*> x"), ("x  y  ", "x <*>"), ("k =  v  w ;", "k = <*> ;"),
        ("a b c", "a <*> c"), ("one   two   three", "<*> two <*>"), ("x y\n", "x <*>"), ("x y\nz", "x <*>"), ("x\ny z", "x y <*>"),
        ("", "<*>"), ("   ", "<*>"), ("a   b", "a <*> <*> b"),
    ]
    assert extracted(spark, rows) == [lazy(*row, True) for row in rows]


def test_nulls_and_names_that_clash(spark):
    df = spark.createDataFrame([(None, "a <*>", [1]), ("a 1", None, None), ("a 1", "a <*>", [2])], "Content string, EventTemplate string, spans array<int>")
    assert [r.ParameterList for r in extract_parameters(df).collect()] == [[], [], ["1"]]


def test_a_message_that_does_not_fit_costs_one_pass(spark):
    template = "a <*> a <*> a <*> a <*> a <*> b"
    df = spark.range(400).select(
        F.repeat(F.lit("a "), (F.col("id") + 1).cast("int")).alias("Content"), F.lit(template).alias("EventTemplate")
    )
    extract_parameters(df).count()
    start = time.perf_counter()
    assert extract_parameters(df).where(F.size("ParameterList") > 0).count() == 0
    assert time.perf_counter() - start < 20
