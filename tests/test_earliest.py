"""Leaders by prefixes equal a scan in order, however dense the rows are and wherever the prefixes end."""

import random

import pytest
from pyspark.sql import functions as F

from lineloom.operators import earliest
from lineloom.workspace import Workspace


def scan(rows, near):
    leaders = []
    for bucket, first, value in sorted(rows, key=lambda r: r[1]):
        if not any(b == bucket and abs(v - value) <= near for b, v in leaders):
            leaders.append((bucket, value))
            yield first


def pool(spark, rows):
    df = spark.createDataFrame(rows, "Bucket string, First bigint, Value bigint").repartition(3)
    return df.select("Bucket", "First", F.array(F.col("Value").cast("string")).alias("Tokens"))


def reach_within(near):
    def reach(rows, leaders):
        value = lambda side: F.col(f"{side}.Tokens")[0].cast("bigint")
        close = (F.col("a.Bucket") == F.col("b.Bucket")) & (F.col("b.ClusterId") < F.col("a.First"))
        close = close & (F.abs(value("a") - value("b")) <= near)
        return rows.alias("a").join(leaders.alias("b"), close).select("First", "ClusterId")

    return reach


@pytest.mark.parametrize("seed,near,heads,ranked,dense", [(1, 3, 8, 1000, 64), (2, 10, 8, 4, 64), (3, 30, 16, 1000, 0)])
def test_prefixes_equal_a_scan(spark, monkeypatch, seed, near, heads, ranked, dense):
    monkeypatch.setattr(earliest, "FIRST_HEADS", heads)
    monkeypatch.setattr(earliest, "_RANKED", ranked)
    monkeypatch.setattr(earliest, "DENSE", dense)
    rng = random.Random(seed)
    # sparse ids in no order, and one bucket with most rows
    firsts = rng.sample(range(10**12), 150)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), first, rng.randrange(200)) for first in firsts]
    got = earliest.find_earliest(pool(spark, rows), reach_within(near), Workspace(spark))
    assert sorted(r.ClusterId for r in got.collect()) == sorted(scan(rows, near))


def test_a_chain_is_settled_in_order(spark):
    # each row is reached by the one before it only: every second one leads
    rows = [("x", i, 10 * i) for i in range(12)] + [("y", 100, 0)]
    got = earliest.find_earliest(pool(spark, rows), reach_within(10), Workspace(spark))
    assert sorted(r.ClusterId for r in got.collect()) == [0, 2, 4, 6, 8, 10, 100]


def test_no_rows(spark):
    got = earliest.find_earliest(pool(spark, []), reach_within(1), Workspace(spark))
    assert got.count() == 0 and got.columns == ["Bucket", "ClusterId", "Tokens"]
