import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels embeddings pages conversations events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert catalog.oracle_sql().keys() <= catalog.queries().keys()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_equals_sql(spark, con, name):
    rows = catalog.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted(repr(tuple(r)) for r in rows.select(*columns).collect())
    if name in catalog.oracle_sql():
        relation = con.sql(catalog.oracle_sql()[name])
        assert sorted(relation.columns) == columns
        assert got == sorted(repr(tuple(r[relation.columns.index(c)] for c in columns)) for r in relation.fetchall())
    else:
        assert got
