"""Every registered query against its SQL on the smallest driver tables."""

import os
import re

import pytest
from oracle import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("SLOFRAME_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def own(names):
    """Queries of this folder; corpus queries have tests of their own."""
    return sorted(n for n in names if not re.match(r"op\d+_|pipeline", n))


@pytest.mark.parametrize("name", own(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    _, problem = compare(spark, con, queries()[name], oracle_sql()[name], SF)
    assert problem is None, problem


@pytest.mark.parametrize("name", own(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, SF).columns


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
