import duckdb
import pytest

from vellum.llm import queries as corpus


@pytest.mark.parametrize("name", list(corpus.oracle_sql()))
def test_query_agrees_with_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = corpus.queries()[name](spark, sf_dir)
    want = con.execute(corpus.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(repr(tuple(r[n] for n in sorted(names))) for r in got.collect()) == sorted(repr(tuple(dict(zip(names, r, strict=True))[n] for n in sorted(names))) for r in want.fetchall())


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in corpus.queries()) == list(range(1, 11))
