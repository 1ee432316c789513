"""Registered queries against their SQL counterparts on the smallest data set."""

import os

import pytest
from oracle import DATA, compare, connect

import __spark_entry__ as contract

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, FOLDER)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["ml_predict", "ml_evaluate", "txt_stem_vocab", "src_binary_files"])
def test_rows_only_queries(spark, name):
    rows = contract.queries()[name](spark, FOLDER)
    assert rows.count() > 0
    if name == "ml_evaluate":  # floors are asserted on a separable fixture in test_models
        r = rows.first()
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == r["test_samples"] and 0 <= r["roc_auc"] <= 1
