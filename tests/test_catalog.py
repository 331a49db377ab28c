"""Every catalogue query against its oracle in DuckDB; queries without one must run and give rows."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from toposcan.plans import catalog  # noqa: E402
from toposcan.plans.views import TABLES  # noqa: E402
from tools.check import compare  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    ok, message, *_ = compare(spark, duck, SF, name, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert ok, message


def _orders(n):
    """``n`` orders with many scores that are equal but for rounding (1998.55 of price is worth 0.15 of occurrence), and customers near some of them."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders AS SELECT i AS o_orderkey, CAST(1998.55 * (i % 211) AS DECIMAL(15, 2)) AS o_totalprice, '1-URGENT' AS o_orderpriority FROM range({n}) t(i)")
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, 1.0 AS c_acctbal FROM range(200) t(i)")
    return con


@pytest.mark.parametrize("name", ["win1_rank", "win2_running_precision"])
def test_ranks_follow_the_documented_score(spark, tmp_path, name):
    """Scores that differ in the last bit only must rank alike on both sides."""
    con = _orders(20_000)
    for t in ("orders", "customer"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    ok, message, *_ = compare(spark, con, str(tmp_path), name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert ok, message
