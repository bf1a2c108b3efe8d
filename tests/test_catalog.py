"""Every registered query against its oracle at the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from alertloom.plans import catalog  # noqa: E402
from check_oracle import TABLES, canonical  # noqa: E402

QUERIES, SQL = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck(data_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_oracle(spark, duck, data_dir, name):
    got = QUERIES[name](spark, data_dir).toArrow()
    if name not in SQL:
        assert got.num_rows > 0
        return
    want = duck.sql(SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert canonical(got) == canonical(want)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"m1_phishing_scores"}


def test_entry_registers_all_of_them():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark, data_dir):
    df = entry.entry(spark)
    assert df.columns == ["artifact_id", "rule_count", "risk_score", "verdict"] and df.count() > 0
