"""Every query runs at the smallest size; those with SQL give the same rows in DuckDB."""

import os

import duckdb
import numpy as np
import pytest

from granary.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and np.isnan(x)):
        return "null"
    if isinstance(x, bool | np.bool_):
        return str(bool(x))
    if isinstance(x, list | tuple | np.ndarray):
        return str([plain(y) for y in x])
    if isinstance(x, str):
        return x
    return f"{round(float(x), 6) + 0.0:.6f}" if isinstance(x, int | float | np.number) or type(x).__name__ == "Decimal" else str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_partitioning_changes_nothing(spark):
    """Results don't hang on how rows are dealt."""
    for name in ("rrf_fusion", "ttl_cache_hits", "history_token_budget", "paragraph_blocks"):
        out = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(map(str, catalog.QUERIES[name](spark, SF).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert out[0] == out[1]
