import os

import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
CORE = __import__("strataweave.plans.catalogue", fromlist=["x"]).queries()


def test_contract():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(CORE) <= set(queries)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "id", "score", "pick"] and df.count() >= 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(CORE))
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = CORE[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)

    def form(rows, columns):
        order = sorted(range(len(columns)), key=columns.__getitem__)
        return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)

    assert form(rows, df.columns) == form(result.fetchall(), columns)
