"""Every query that SQL can express gives the rows of its SQL."""

import os
import re

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not re.match(r"op\d+_|pipeline$", k)}
QUERIES = __spark_entry__.queries()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    one = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(got.select(*(f"`{c}`" for c in columns)).collect()) == plain(want.select(quoted).fetchall() if hasattr(want, "select") else [])


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(QUERIES)


def test_flagship_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
