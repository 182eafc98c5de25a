"""Every catalogued query against its SQL statement over the smallest tables."""

import math
from pathlib import Path

import pytest

from playtrace.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF_DIR).is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_statement(spark, duck, name):
    got = catalogue.queries()[name](spark, SF_DIR)
    want = duck.execute(SQL[name])
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table([x[0] for x in want.description], want.fetchall())


def test_all_statements_belong_to_queries():
    assert set(SQL) <= set(catalogue.queries())
