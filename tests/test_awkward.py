"""Every query of the library on tables with nulls, empty texts and zero vectors, and on tables without rows."""

import duckdb
import pytest

from tessera import catalog
from tests import awkward


@pytest.fixture(scope="module", params=["nulls", "none"])
def tables(request, tmp_path_factory):
    folder = awkward.write(tmp_path_factory.mktemp(request.param), request.param == "none")
    con = duckdb.connect()
    for t in awkward.TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_equals_sql(spark, tables, name):
    folder, con = tables
    rows = catalog.queries()[name](spark, folder)
    columns = sorted(rows.columns)
    got = sorted(repr(tuple(r)) for r in rows.select(*columns).collect())
    if name in catalog.oracle_sql():
        relation = con.sql(catalog.oracle_sql()[name])
        assert got == sorted(repr(tuple(r[relation.columns.index(c)] for c in columns)) for r in relation.fetchall())
