"""Every query against its SQL on the smallest scale factor."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    got, want, _, same = compare(spark, con, name, SF)
    assert same, f"{name}: {len(got)} rows against {None if want is None else len(want)}"


def test_entry_has_rows(spark):
    assert entry(spark).count() == 12
