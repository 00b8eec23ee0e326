"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

from tallyframe.plans.registry import ORACLE_SQL, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return "null"
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


def normal(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    if not FOLDER.is_dir():
        pytest.skip("no test tables here")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sql, name):
    got = QUERIES[name](spark, str(FOLDER)).toPandas()
    if name in ORACLE_SQL:
        want = sql.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)


def test_gap_clusters_agrees_with_sql_on_orders_without_a_day(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    days = ["NULL", "TIMESTAMP '2000-05-01 23:00:00'", "TIMESTAMP '2000-05-01 01:00:00'", "TIMESTAMP '1969-12-31 12:00:00'", "NULL", "TIMESTAMP '2000-06-30 00:00:00'"]
    con = duckdb.connect(config={"threads": 1})  # with more threads the SQL's second window may put equal days in any order
    con.sql("create table orders as " + " union all ".join(f"select {i}::bigint as o_orderkey, {c} as o_custkey, {d} as o_orderdate" for c in ("1::bigint", "NULL::bigint") for i, d in enumerate(days)))
    con.sql(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    got = QUERIES["gap_clusters"](spark, str(tmp_path)).toPandas()
    assert normal(got) == normal(con.sql(ORACLE_SQL["gap_clusters"]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
