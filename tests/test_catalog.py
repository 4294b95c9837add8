"""Every query of the catalogue against its SQL, and no Python in its plan."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from linkspan.plans import catalog  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "CartesianProduct" not in plan
    rel = duck.sql(catalog.ORACLES[name])
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    want = sorted(map(str, rel.select(*[f'"{c}"' for c in cols]).fetchall()))
    got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
    assert got == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
