"""The dialect's operators as queries over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.engine import Engine
from vellum.sources.catalog import Mappings

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
FLAGSHIP = """
SELECT TOP 20 o.o_orderkey AS orderkey, c.c_name AS customer, n.n_name AS nation, l.l_extendedprice AS price
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE c.c_mktsegment = 'BUILDING' AND l.l_returnflag IN ('R', 'A') ORDER BY l.l_extendedprice DESC, o.o_orderkey, l.l_linenumber"""

#: Query in the dialect; SQL for the oracle, where it isn't the same.
SQL: dict[str, tuple[str, str | None]] = {
    "scan_star": ("SELECT * FROM nation", None),
    "project_cols": ("SELECT n_name, n_regionkey FROM nation", None),
    "project_alias": ("SELECT p_name AS part_name, p_retailprice AS price FROM part", None),
    "project_implicit_alias": ("SELECT s_name supplier_name FROM supplier", None),
    "project_collision": ("SELECT d.doc_id, l.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id", 'SELECT d.doc_id AS "d.doc_id", l.doc_id AS "l.doc_id", l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id'),
    "filter_eq_text": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", None),
    "filter_eq_num_tol": ("SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount = 0.05", "SELECT l_orderkey, l_discount FROM lineitem WHERE abs(l_discount - 0.05) < 0.0001"),
    "filter_ne": ("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'", None),
    "filter_gt_lt": ("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size < 20", None),
    "filter_ge_le": ("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20", None),
    "filter_bool_tree": ("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT o_orderpriority = '5-LOW'", None),
    "filter_not_two_valued": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.quality = 1)", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.quality = 1, false)"),
    "filter_text_ge_is_eq": ("SELECT n_name FROM nation WHERE n_name >= 'NATION_3'", "SELECT n_name FROM nation WHERE n_name = 'NATION_3'"),
    "filter_unsupported_is_false": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 1 AND 10 OR p_size = 50", "SELECT p_partkey FROM part WHERE p_size = 50"),
    "like_prefix": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%'", None),
    "like_underscore": ("SELECT n_name FROM nation WHERE n_name LIKE 'NATION__'", None),
    "not_like": ("SELECT p_partkey FROM part WHERE p_type NOT LIKE '%ECONOMY%'", None),
    "ilike": ("SELECT p_partkey FROM part WHERE p_type ILIKE 'econ%'", None),
    "not_ilike": ("SELECT p_partkey FROM part WHERE p_type NOT ILIKE '%econ%'", None),
    "in_text": ("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')", None),
    "in_num": ("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 10)", None),
    "not_in": ("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING')", None),
    "is_null_left_join": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL", None),
    "is_not_null": ("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL", None),
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_left": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", None),
    "join_swapped_operands": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey", None),
    "join_chain": ("SELECT s.s_name, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "join_self": ("SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", None),
    "anti_join": ("SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL", None),
    "unnest_scalar": ("SELECT vec_id, x FROM embeddings, UNNEST(embedding) AS t(x)", "SELECT vec_id, unnest(embedding) AS x FROM embeddings"),
    "unnest_where": ("SELECT vec_id, x FROM embeddings, UNNEST(embedding) AS t(x) WHERE x > 0.2", "SELECT vec_id, x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x > 0.2"),
    "order_top": ("SELECT TOP 10 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "order_limit": ("SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25", None),
    "top_zero": ("SELECT TOP 0 * FROM region", "SELECT * FROM region LIMIT 0"),
    "distinct_one": ("SELECT DISTINCT c_mktsegment FROM customer", None),
    "distinct_multi": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "distinct_after_limit": ("SELECT DISTINCT o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 3", "SELECT DISTINCT o_orderstatus FROM (SELECT o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 3)"),
    "cte_simple": ("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000) SELECT o_orderkey FROM big", None),
    "cte_chain": ("WITH a AS (SELECT * FROM part WHERE p_size > 40), b AS (SELECT p_partkey, p_brand FROM a WHERE p_brand LIKE 'Brand#1%') SELECT * FROM b", None),
    "cte_join": ("WITH rich AS (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000) SELECT o.o_orderkey, r.c_name FROM orders o JOIN rich r ON o.o_custkey = r.c_custkey", None),
    "cte_order_limit": ("WITH s AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey) SELECT o_orderkey FROM s LIMIT 5", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5"),
    "nested_path": ("SELECT event_id, props.k FROM events WHERE props.k > 50", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50"),
    "params": ("SELECT p_partkey FROM part WHERE p_size > ${min_size:45}", "SELECT p_partkey FROM part WHERE p_size > 45"),
    "flagship": (FLAGSHIP, FLAGSHIP.replace("TOP 20 ", "") + " LIMIT 20"),
}
#: Rows of a JSON document, which one task reads.
DOCUMENT_ROWS = 2000
OTHER_SQL = {
    "json_scan": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1",
    "json_unnest": "SELECT o_custkey AS cust, o_orderkey AS okey FROM orders WHERE o_totalprice > 250000",
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the Parquet tables."""
    out = Engine(spark)
    out.catalog.register_folder(sf_dir, [t for t in TABLES if t != "events"])
    return out


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = engine(spark, sf_dir)
        if " events" in text:
            own.catalog.register("events", spark.read.parquet(f"{sf_dir}/events.parquet"), {"props": "k long"})
        return own.sql(text)

    return run


def _shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return (named or (held.get() if held.isDefined() else tempfile.mkdtemp(prefix="vellum-"))).rstrip("/")


def _json_files(spark: SparkSession, df: DataFrame, name: str, file: str) -> Engine:
    """An engine with a table of df's rows, each as an object's field doc, in documents of about DOCUMENT_ROWS rows under a folder."""
    folder = f"{_shared(spark)}/vellum-json-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64(*df.columns[:1]), F.lit(max(1, -(-df.count() // DOCUMENT_ROWS))))
    documents = df.select(part.alias("part"), F.struct(F.struct(*df.columns).alias("doc")).alias("row")).groupBy("part").agg(F.collect_list("row").alias("data"))
    documents.select("data").write.option("maxRecordsPerFile", 1).json(f"{folder}/{file}")  # a file is one document
    mappings = Mappings()
    mappings.add(name, f"{file}:$.data")
    return Engine(spark, mappings, folder)


def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as a JSON file: a mapping, paths, filters and projection over variants."""
    df = _json_files(spark, spark.read.parquet(f"{sf_dir}/nation.parquet"), "docs", "nation.json").sql("SELECT doc.n_nationkey, doc.n_name FROM docs WHERE doc.n_regionkey = 1")
    return df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.col("n_name").cast("string").alias("n_name"))


def json_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as one JSON object in files, unnested again."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    nested = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("orders"))  # a customer's own orders
    df = _json_files(spark, nested, "docs", "orders.json").sql("SELECT doc.o_custkey AS cust, o.o_orderkey AS okey FROM docs, UNNEST(doc.orders) AS x(o) WHERE o.o_totalprice > 250000")
    return df.select(F.col("cust").cast("bigint").alias("cust"), F.col("okey").cast("bigint").alias("okey"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(text) for k, (text, _) in SQL.items()} | {"json_scan": json_scan, "json_unnest": json_unnest}


def oracle_sql() -> dict[str, str]:
    return {k: other or text for k, (text, other) in SQL.items()} | OTHER_SQL
