import duckdb
import pytest

from dupscan.llm import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalogue.ORACLE_SQL)
def test_query_as_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=key) == sorted(map(tuple, want.select(*order).fetchall()), key=key)


def test_an_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in catalogue.QUERIES if k.startswith("op")) == list(range(1, 11))
