import duckdb
import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"


def test_flagship(spark):
    rows = contract.entry(spark).collect()
    assert {r.EventTemplate for r in rows} == set(contract.TEMPLATES.values())


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(contract._own_queries()) - set(contract.oracle_sql()) == {"D8_parse_documents"}


@pytest.mark.parametrize("name", [
    "A4_parse_log_lines", "A5_load_log", "B8_preprocess", "C2_ngram_similarity", "C4_combined_similarity", "D8_parse_files",
    "H1_slct_combined", "H1_slct_outliers", "D3_mine_leader", "E1_correct_template", "F10_evaluate_full",
])
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in ("events", "documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = sorted(repr(row) for row in result.fetchall())
    df = contract.queries()[name](spark, DATA)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want
