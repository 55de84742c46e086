import duckdb
import pytest

from cutgraph.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        told = con.execute(ORACLES[name])
        columns = [d[0] for d in told.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        assert got == sorted((tuple(r[i] for i in order) for r in told.fetchall()), key=repr)
