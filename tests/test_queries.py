"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from loomwork.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf_dir, con):
    frame = catalog.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = [tuple(map(plain, r)) for r in frame.select(*columns).collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got or name == "greedy_duplicates"
        return
    con.execute(f"create or replace temp table found as {sql}")
    want = [tuple(map(plain, r)) for r in con.execute(f"select {', '.join(columns)} from found").fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry_imports(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() == 5
