"""Every registered query next to its SQL at the smallest scale; the SQL-less ones must run."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    problem, n, *_ = check(spark, SF, con, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None, problem
    assert n >= 0
