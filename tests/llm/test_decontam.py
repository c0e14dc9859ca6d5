import hashlib
import re

from tessera.llm import common, decontam
from tests.llm import fixtures


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, size=13):
    """[(doc_id, n_words, n_hit, item ids, contaminated)]"""
    out, parts = [], []
    for item, text in items:
        w = words(text)
        parts += [(item, w[i : i + size]) for i in range(max(0, len(w) - size) + 1) if w]
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for item, part in parts:
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    named |= {str(item)} - {"None"}
        out.append((doc, len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def check(spark, docs, items):
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.mark(docs, frame).collect()
    assert sorted(((r["doc_id"], r["_n_words"], r["_n_hit"], r["_items"], r["_contaminated"]) for r in got), key=repr) == plain([(d["doc_id"], d["text"]) for d in docs.collect()], items)
    return got


def test_awkward_rows(spark):
    base = dict(enumerate(r[1] for r in fixtures.rows()))
    items = [(1, base[13][:400]), (2, base[13][50:300].upper()), (10, "Two  words"), (3, None), (4, "!!"), (5, ""), (6, "same same " * 20), (7, "naïve délta"), (8, "absent words only"), (9, "word"), (1, "12345"), (None, "trail")]
    docs = fixtures.clashing(fixtures.frame(spark, [(None, base[13], None, None, None), (13, base[13], None, None, None), (13, "other text, two words", None, None, None)]))
    got = check(spark, docs, items)
    assert any(r["_contaminated"] for r in got) and all(r["n_words"] == "clash" for r in got)
    check(spark, docs, [])
    check(spark, docs, [(1, "zzz qqq")])
    assert decontam.mark(fixtures.empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_tables_too_large_for_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    base = dict(enumerate(r[1] for r in fixtures.rows()))
    items = [(1, base[13][:400]), (2, "word"), (3, "same same " * 20), (4, base[13][:400]), (5, "of1 alpha2")]
    assert any(r["_contaminated"] for r in check(spark, fixtures.frame(spark), items))


def test_given_tables_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{fixtures.SF}/{t}.parquet'")
    relation = con.sql(decontam.ORACLE)
    got = decontam.op3_decontamination(spark, fixtures.SF).select(*relation.columns).collect()
    assert sorted(map(tuple, got)) == sorted(relation.fetchall())
    assert hashlib.sha256(b"").hexdigest() in {r["items_sha256"] for r in got}


def test_no_python_in_the_plan(spark):
    plan = decontam.op3_decontamination(spark, fixtures.SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
