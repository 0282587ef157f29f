"""Every named query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from mineralis.plans import all_queries, all_sql
from oracle_check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
FNS, SQL = all_queries(), all_sql()
# iterative operators without a twin are tested against brute force in test_iterative.py
NAMES = [n for n in FNS if n in SQL]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, message = compare(spark, con, SF_DIR, FNS[name], SQL[name])
    assert ok, message


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
