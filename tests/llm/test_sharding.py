import duckdb
import pytest

from tessera.llm import sharding
from tests.llm import fixtures


def filled(names, m):
    import hashlib

    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    offset = [number(n + ":offset") % m for n in names]
    step = [number(n + ":step") % (m - 1) + 1 for n in names]
    table, following = [None] * m, [0] * len(names)
    for k in range(m):
        i = k % len(names)
        while table[(offset[i] + following[i] * step[i]) % m] is not None:
            following[i] += 1
        table[(offset[i] + following[i] * step[i]) % m] = names[i]
        following[i] += 1
    return table


@pytest.mark.parametrize("n, m", [(1, 2), (3, 7), (7, 211), (32, 4099)])
def test_table_equals_plain_loop(spark, n, m):
    names = sharding.shard_names(n)
    got = [r["shard"] for r in sharding.lookup_table(spark, names, m).orderBy("slot").collect()]
    assert got == filled(names, m)


def test_awkward_rows(spark):
    docs = fixtures.clashing(fixtures.frame(spark, [(None, "x", None, None, None), (0, "x", None, None, None)]))
    got = sharding.assign_shards(docs, ["doc_id"]).collect()
    assert len(got) == docs.count()
    assert len({r["_shard"] for r in got if r["doc_id"] == 0}) == 1
    assert all(r["slot"] == "clash" for r in got)
    assert sharding.assign_shards(fixtures.empty(spark), ["doc_id", "source"]).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, ["a", "b"], 4)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{fixtures.SF}/documents.parquet'")
    want = sorted(con.sql(sharding.ORACLE).fetchall())
    assert sorted(map(tuple, sharding.op1_sharding(spark, fixtures.SF).collect())) == want
