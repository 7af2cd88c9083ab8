import duckdb
import pytest

import __spark_entry__
from landloom.plans.registered import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


def norm(v):
    if hasattr(v, "as_tuple"):
        v = float(v)
    return (0, "") if v is None else (1, f"{v:.5f}") if isinstance(v, float) and not isinstance(v, bool) else (1, str(int(v)) if isinstance(v, (bool, int)) else str(v))


def test_contract(spark):
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    as_float = lambda x: float(x) if isinstance(x, int) and not isinstance(x, bool) else x
    want = sorted(tuple(norm(as_float(r[i])) for i in at) for r in rel.fetchall())
    assert sorted(tuple(norm(as_float(r[c])) for c in cols) for r in got) == want
