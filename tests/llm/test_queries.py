import os

import pytest

from strataweave.llm import queries as corpus

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["tab", "rec_id", "seg_no", "lang"],
    "p2_found": ["id_a", "id_b"],
    "p3_found": ["tab", "rec_id", "pii_type", "val_key"],
    "p5_found": ["tab", "id_a", "id_b"],
    "p6_found": ["id_a", "id_b"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "level"],
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(corpus.QUERIES))
def test_query(spark, name):
    if name.startswith("p7") and not os.path.isdir("/opt/tokenizers"):
        pytest.skip("no tokenizer files here")
    df = corpus.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and rows and len(rows) == len(set(rows))
        if "id_a" in df.columns:
            a = df.columns.index("id_a")
            assert all(r[a] < r[a + 1] for r in rows)
    sql = corpus.oracle_sql().get(name)
    if sql:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for f in os.listdir(FOLDER):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
        assert sorted(rows) == sorted(con.execute(sql).fetchall())
