"""Every query of the dialect against DuckDB over the same tables."""

import duckdb
import pytest

import __spark_entry__
from vellum import json_queries
from vellum import queries as own


def plain(rows):
    return sorted(repr(tuple(r[k] for k in sorted(r))) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in own.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [*own.queries(), *json_queries.queries()])
def test_query(name, spark, sf_dir, duck):
    df = (own.queries() | json_queries.queries())[name](spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    rel = duck.execute((own.oracle_sql() | json_queries.oracle_sql())[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(got) == plain([dict(zip(names, r, strict=True)) for r in rel.fetchall()])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = own.queries()["filter_ge_le"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,10)" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
    plan = own.queries()["flagship"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "In(l_returnflag, [A,R])" in plan and "l_tax" not in plan


@pytest.mark.parametrize("name", ["json_scan", "json_unnest"])
def test_json_queries_read_json_files(name, spark, sf_dir):
    files = own.queries()[name](spark, sf_dir).inputFiles()
    assert files and all(f.endswith(".json") for f in files)


def test_streams(spark, tmp_path):
    from vellum import streaming
    from vellum.engine import Engine
    from vellum.errors import UnsupportedError

    (tmp_path / "in").mkdir()
    spark.range(10).withColumnRenamed("id", "i").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema("i long").parquet(str(tmp_path / "in" / "*"))
    out = streaming.sql(Engine(spark), "SELECT s.i AS j FROM s WHERE i >= 7", s=stream)
    q = out.writeStream.format("memory").queryName("vellum_test").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.j for r in spark.table("vellum_test").collect()) == [7, 8, 9]
    with pytest.raises(UnsupportedError):
        streaming.sql(Engine(spark), "SELECT i FROM s LIMIT 3", s=stream)
