import importlib
import sys

import duckdb
import pytest

from dupscan.plans import catalogue, file_queries  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_as_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in order) for r in rows), key=key) == sorted(map(tuple, want.select(*order).fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id_a", "id_b", "mse"]


@pytest.mark.parametrize("hidden", ["dupscan.llm", "dupscan.llm.catalogue", "regex", "xxhash"])
def test_entry_without_the_optional_parts(monkeypatch, hidden):
    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("dupscan.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, hidden, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    bare = importlib.import_module("__spark_entry__")
    if hidden == "xxhash":  # which is imported where it is used
        assert set(catalogue.QUERIES) <= set(bare.queries())
    else:
        assert set(bare.queries()) == set(catalogue.QUERIES) and set(bare.oracle_sql()) == set(catalogue.ORACLE_SQL)
    monkeypatch.setitem(sys.modules, "__spark_entry__", entry)
