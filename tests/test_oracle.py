"""Every query with SQL against DuckDB, on the smallest tables."""

import pytest
from oracle import canonical, connect

from shardloom.plans.catalog import QUERIES, SQL

from conftest import DATA


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    found = canonical(QUERIES[name](spark, DATA).toPandas())
    assert found == canonical(con.sql(SQL[name]).df())


def test_names_are_operator_ids():
    ids = {n.split("_")[0] for n in QUERIES}
    wanted = {*(f"B{i}" for i in range(1, 22)), *(f"C{i}" for i in range(1, 24)), *(f"D{i}" for i in range(1, 25)), *(f"E{i}" for i in range(1, 13)), *(f"F{i}" for i in range(1, 7)), *(f"A{i}" for i in range(12, 24))}
    assert wanted <= ids
