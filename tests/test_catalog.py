"""Every core query on the smallest tables against its SQL, where the tables are there."""

import math
import os

import pytest

from stipple.plans import catalog

AT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(AT), reason="the test tables are not here")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(AT):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from '{AT}/{f}'")
    return c


def rows(records, names):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)

    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in records)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = catalog.queries()[name](spark, AT)
    got = sql.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(got.fetchall(), names)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
