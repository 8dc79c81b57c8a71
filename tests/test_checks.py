"""Every registered query against its SQL check on whole tables."""

import importlib

import pytest

from oracle import connect, difference

entry = importlib.import_module("__spark_entry__")
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    if name in CHECKS:
        problem = difference(spark, con, sf_dir, QUERIES[name], CHECKS[name])
        assert problem is None, problem
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_checks_name_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["tn"] + row["fp"] + row["fn"] + row["tp"] > 0
