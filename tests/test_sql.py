"""Every query with SQL gives the rows of that SQL; every other one runs."""

import math

import duckdb
import pytest

from lectern import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck, tiny):
    df = catalog.QUERIES[name](spark, tiny)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    said = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(said.columns)
    places = [said.columns.index(c) for c in columns]
    ours = sorted(([plain(r[c]) for c in columns] for r in rows), key=repr)
    theirs = sorted(([plain(r[i]) for i in places] for r in said.fetchall()), key=repr)
    assert ours == theirs
