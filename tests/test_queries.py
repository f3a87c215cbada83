"""Every registered query of the engine against its SQL, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from knotwork.plans import catalog

FOLDER = "/root/testdata/sf0.001"
#: Plans whose every step is a job; tests/test_engine.py runs them all on small graphs, and the
#: driver on these queries.
SLOW = {n for n in catalog.QUERIES if n.endswith("_distributed")} - {"scc_coloring_distributed", "insert_m11_distributed"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(x):
    return float(x) if isinstance(x, decimal.Decimal) else round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in catalog.SQL:
        assert rows
        return
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(rows, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["scc_acyclic", "topo_levels"])
def test_part_keys_as_large_as_supplier_ids(spark, tmp_path, name):
    """A part's key that a supplier's vertex is named by, too, gives two rows, as in the SQL."""
    folder = tmp_path.as_posix()
    spark.createDataFrame([(1_000_001, 1), (1_000_001, 2), (1, 1), (1_000_003, 3)], "l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    got = catalog.QUERIES[name](spark, folder)
    want = duckdb.sql(catalog.SQL[name].replace("lineitem", f"'{folder}/lineitem.parquet/*.parquet'"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_orders_are_followed_across_partitions(spark, tmp_path):
    """Two orders on, in partitions of any number of rows, even none: as by SQL's lead."""
    folder = tmp_path.as_posix()
    rows = [(i, i * 7 % 11, "OP"[i % 2], f"2024-01-{1 + i * 5 % 9:02} 00:00:00", str(i % 3)) for i in range(23)]
    o = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_orderpriority string")
    o.withColumn("o_orderdate", o.o_orderdate.cast("timestamp")).write.parquet(f"{folder}/orders.parquet")
    w = "OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey)"
    leads = ", ".join(f"lead(o_orderpriority, {k}) {w}, lead(o_custkey, {k}) {w}" for k in (1, 2))
    want = duckdb.sql(f"SELECT o_orderkey, {leads} FROM '{folder}/orders.parquet/*.parquet'").fetchall()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = catalog.fx.placed_orders(spark, folder).select("key", "priority_1", "custkey_1", "priority_2", "custkey_2").collect()
            assert sorted(map(tuple, got)) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
