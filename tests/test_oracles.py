"""Every query with a SQL twin gives the same rows as DuckDB."""

import pytest

from __spark_entry__ import entry
from examloom.plans import ORACLES, QUERIES
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    state, rows, _, note = compare(spark, con, FOLDER, name)
    assert state in ("ok", "EMPTY"), note
    assert not note, note


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() == 1
