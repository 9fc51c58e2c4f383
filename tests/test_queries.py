"""Every query against its SQL twin."""

from collections import Counter

import duckdb
import pytest

from deltaloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(found):
    return Counter(repr(tuple(r)) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, sf_dir, name):
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(*(f"`{c}`" for c in want.columns)).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
