"""Every query of the catalogue against its SQL over the tables of the smallest scale but one."""

import duckdb
import pytest

from jobtide.plans import catalogue, hot, replays, systems  # noqa: F401

SF_DIR = "/root/testdata/sf0.01"
TABLES = ("customer", "orders", "lineitem", "part", "events", "documents", "pages", "nation", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_is_its_sql(spark, duck, name):
    if name not in catalogue.ORACLES:
        pytest.skip("no SQL")
    found = catalogue.QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    rows = sorted((plain(tuple(r[c] for c in columns)) for r in found.collect()), key=repr)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((plain(tuple(r[i] for i in at)) for r in want.fetchall()), key=repr)
