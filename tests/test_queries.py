"""All SQL-backed queries against DuckDB at the smallest size, if the tables are there."""

import os

import pytest

from verdant.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert got == rows(columns, found.fetchall())
