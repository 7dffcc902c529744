"""Queries that write out verdicts against their SQL, on results whose sums decide the verdict at a threshold."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from oracle import compare
from quarrylens.plans.catalog import QUERIES, SQL

# Orders of one customer: key, and digit of the priority. Their verdict is another if weights are added as doubles (the first three) or
# hits as decimals (the last three); the SQL adds weights as decimals and hits as doubles in the order of the table.
TIES = [
    [(18, 4), (210, 1), (211, 3), (244, 2)],
    [(144, 4), (167, 2), (308, 3), (336, 1)],
    [(72, 5), (134, 3), (171, 1), (179, 3), (181, 2), (189, 2), (381, 1)],
    [(33, 3), (74, 2), (165, 5), (308, 1), (370, 4)],
    [(4, 3), (19, 5), (235, 1), (337, 4), (370, 4)],
    [(49, 5), (165, 2), (317, 1), (370, 4)],
]

# Their share of suspicious hits is a quarter if these are added in falling order of their keys, and just less in rising order.
FALLING = [
    [(114, 4), (184, 2), (317, 3), (1218, 5), (1436, 5), (1522, 5), (1574, 5), (1809, 1)],
    [(151, 2), (602, 2), (625, 5), (642, 2), (818, 3), (849, 3), (914, 3), (1692, 4), (1727, 3), (1992, 5)],
]


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    """Four customers a tie, one of each type of indicator, and one with so many results that its confidence is 0.0004."""
    rows = [(order, 4 * i + k, str(p)) for i, tie in enumerate(TIES) for k in range(4) for order, p in tie]
    rows += [(1600, 7000, "5")] + [(16 * i + 7, 7000, "1") for i in range(600)]
    path = tmp_path_factory.mktemp("ties")
    orders, customers, priorities = zip(*sorted(rows), strict=True)
    pq.write_table(pa.table({"o_orderkey": pa.array(orders, pa.int64()), "o_custkey": pa.array(customers, pa.int64()), "o_orderpriority": priorities}), path / "orders.parquet")
    return str(path)


@pytest.fixture(scope="module")
def files_at(tmp_path_factory):
    """Two files in falling order of their keys; hits are added in the order of the files."""
    rows = sorted(((order, 4 * i + k, str(p)) for i, tie in enumerate(FALLING) for k in range(4) for order, p in tie), reverse=True)
    path = tmp_path_factory.mktemp("files")
    (path / "orders.parquet").mkdir()
    for n, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        orders, customers, priorities = zip(*part, strict=True)
        pq.write_table(pa.table({"o_orderkey": pa.array(orders, pa.int64()), "o_custkey": pa.array(customers, pa.int64()), "o_orderpriority": priorities}), path / "orders.parquet" / f"part-{n}.parquet")
    return str(path)


VERDICTS = ["misp_rows", "report_counts", "report_json", "report_markdown", "score_verdicts", "severity_floor", "sigma_rows", "stix_rows", "suricata_all", "suricata_rules", "verdict_counts", "weighted_scores"]


@pytest.mark.parametrize("name", VERDICTS)
def test_hits_are_added_in_the_order_of_the_files(spark, files_at, name):
    import duckdb

    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{files_at}/orders.parquet/*.parquet'")
    assert compare(spark, con, QUERIES[name], SQL[name], files_at) == ""


@pytest.mark.parametrize("name", ["report_json", "sigma_rows", "stix_rows", "suricata_all", "suricata_rules"])
def test_rows_of_verdicts_at_a_threshold(spark, at, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{at}/orders.parquet'")
    assert compare(spark, con, QUERIES[name], SQL[name], at) == ""


@pytest.mark.parametrize("name", ["suricata_all", "suricata_rules"])
def test_rows_follow_a_table_that_is_written_anew(spark, tmp_path, name):
    import duckdb

    for n in (100, 300):
        keys = pa.array(range(n), pa.int64())
        pq.write_table(pa.table({"o_orderkey": keys, "o_custkey": keys, "o_orderpriority": ["1"] * n}), tmp_path / "orders.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
        assert compare(spark, con, QUERIES[name], SQL[name], str(tmp_path)) == ""
