"""Every registered query against its SQL in DuckDB on the smallest tables."""

import pytest

from oracle import compare, duck
from quarrylens.plans.catalog import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], DIR) == ""


def test_queries_without_sql_give_rows(spark):
    assert set(QUERIES) - set(SQL) == {"magic_rank"}
    assert all(r["operation"] == "base64" for r in QUERIES["magic_rank"](spark, DIR).where("rank = 1").collect())
