"""Queries over JSON files, the catalog, saved queries and outputs, each with the SQL that it must agree with.

Every query writes its JSON files from the driver's Parquet tables into the shared folder and reads them through mappings.
"""

from __future__ import annotations

import contextlib
import io
import json
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import cli
from vellum.engine import Engine
from vellum.output import emit
from vellum.params import parameter_names, replace_parameters
from vellum.saved import SavedQueries
from vellum.sources.catalog import Mappings

#: Rows of a JSON document of a folder; a document is read by one task.
DOCUMENT_ROWS = 500

#: Rows of one field of many kinds, by number.
ODD = [
    {"i": 1, "v": 10},
    {"i": 2, "v": "9 kg", "w": {"b": 1, "a": [1, 2]}},
    {"i": 3},
    {"i": 4, "v": None},
    {"i": 5, "v": "zebra"},
    {"i": 6, "v": 2.5, "w": {"b": 1, "a": [1, 2]}},
    {"i": 7, "v": "2.5"},
    {"i": 8, "v": "-abc"},
    {"i": 9, "v": "/x", "w": None},
    {"i": 10, "v": -7},
    {"i": 11, "v": True},
    {"i": 12, "v": "15.6 inch", "w": {"a": [2, 1]}},
]

MAPPINGS = {
    "nations": "world.json:$.data.nations",
    "nation": "world.json:$.data.nations[*]",
    "region_rows": "world.json:$.data.regions",
    "regions": "world.json:$.regions[*]",
    "second": "world.json:$.regions[1].nations[*]",
    "deep": "world.json:$..nations[*]",
    "picked": "world.json:$.data.nations[?(@.n_regionkey == 2)]",
    "cut": "world.json:$.data.nations[2:5]",
    "either": "world.json:$.data.nations[0,3]",
    "mixed": "world.json:$.data.mixed",
    "one": "world.json:$.data.nations[7]",
    "nowhere": "world.json:$.data.nothing",
    "scalar": "world.json:$.data.scalar",
    "lists": "world.json:$.regions[*].nations",
    "World": "$.data.nations",
    "odd": "world.json:$.odd",
    "twice": "twice.json:$",
    "customers": "customers:$.customers",
    "broken": "broken.json:$",
    "empty": "empty:$",
    "gone": "gone.json:$",
}


def _shared(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    top = named or (held.get() if held.isDefined() else tempfile.mkdtemp(prefix="vellum-"))
    return f"{top.rstrip('/')}/vellum-json-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, text: str | None) -> None:
    """A small file, or an empty folder, in any store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if text is None:
        fs.mkdirs(p)
        return
    out = fs.create(p)
    out.write(bytearray(text.encode()))
    out.close()


def world(spark: SparkSession, sf_dir: str) -> Engine:
    """One document of the nations and regions (of a fixed size), in several forms, and odd files beside it."""
    nations = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]
    regions = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()]
    nested = [r | {"nations": [n for n in nations if n["n_regionkey"] == r["r_regionkey"]], "info": {"codes": {"all": [r["r_regionkey"], r["r_regionkey"] + 10]}}} for r in regions]
    nested[0]["info"] = {"codes": {"all": []}}
    nested[1]["info"] = {"codes": {"all": 3}}
    mixed = [nations[0], 1, "x", [nations[1]], None, nations[2]]
    folder = _shared(spark)
    _put(spark, f"{folder}/world.json", json.dumps({"data": {"nations": nations, "regions": regions, "mixed": mixed, "scalar": 5}, "regions": nested, "odd": ODD}))
    _put(spark, f"{folder}/twice.json", '[{"k": 1, "v": "old", "v": "new"}]')
    _put(spark, f"{folder}/broken.json", '{"k": [1, ')
    _put(spark, f"{folder}/empty", None)
    mappings = Mappings()
    mappings.entries = MAPPINGS | {"far": f"{folder}/world.json:$.data.nations"}
    return Engine(spark, mappings, folder)


def folder(spark: SparkSession, sf_dir: str) -> Engine:
    """world(), and a folder of documents with the customers and their orders."""
    out = world(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("orders"))  # a customer's own orders
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    part = F.pmod(F.xxhash64("c_custkey"), F.lit(max(1, -(-customers.count() // DOCUMENT_ROWS))))
    rows = customers.join(orders, customers.c_custkey == orders.o_custkey, "left")
    row = F.struct("c_custkey", "c_name", "c_acctbal", F.struct(F.struct(F.col("c_nationkey").alias("key")).alias("nation")).alias("address"), "orders")
    documents = rows.select(part.alias("part"), row.alias("row")).groupBy("part").agg(F.collect_list("row").alias("customers"))
    documents.select("customers").write.option("maxRecordsPerFile", 1).json(f"{out.catalog.data_dir}/customers")  # a file is one document
    return out


def _typed(df: DataFrame, kinds: str) -> DataFrame:
    return df.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in (k.split() for k in kinds.split(", "))])


def _text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "json string")


NATION = "n_nationkey int, n_name string"
_OBJECT = """'{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}'"""

#: Fixture, query, names and types of its columns, SQL for the oracle.
TYPED: dict[str, tuple[Callable, str, str, str]] = {
    "json_single_file": (world, "SELECT n_nationkey, n_name FROM nations WHERE n_regionkey = 1", NATION, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1"),
    "json_folder": (folder, "SELECT c_custkey, c_name FROM customers WHERE c_acctbal > 0", "c_custkey bigint, c_name string", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0"),
    "json_implicit_file": (world, "SELECT n_nationkey, n_name FROM World", NATION, "SELECT n_nationkey, n_name FROM nation"),
    "json_absolute_path": (world, "SELECT n_nationkey, n_name FROM far", NATION, "SELECT n_nationkey, n_name FROM nation"),
    "json_path_index": (world, "SELECT n_nationkey, n_name FROM second", NATION, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1"),
    "json_path_deep": (world, "SELECT n_nationkey, n_name FROM deep", NATION, "SELECT n_nationkey, n_name FROM nation, range(2)"),
    "json_path_filter": (world, "SELECT n_nationkey, n_name FROM picked", NATION, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2"),
    "json_path_slice": (world, "SELECT n_nationkey, n_name FROM cut", NATION, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 2 AND 4"),
    "json_path_union": (world, "SELECT n_nationkey, n_name FROM either", NATION, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (0, 3)"),
    "json_objects_only": (world, "SELECT n_nationkey, n_name FROM mixed", NATION, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (0, 2)"),
    "json_object_row": (world, "SELECT n_nationkey, n_name FROM one", NATION, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7"),
    "json_unmatched_path": (world, "SELECT n_nationkey, n_name FROM nowhere", NATION, "SELECT n_nationkey, n_name FROM nation WHERE false"),
    "json_scalar_path": (world, "SELECT n_nationkey, n_name FROM scalar", NATION, "SELECT n_nationkey, n_name FROM nation WHERE false"),
    "json_nested_arrays": (world, "SELECT n_nationkey, n_name FROM lists", NATION, "SELECT n_nationkey, n_name FROM nation WHERE false"),
    "json_duplicate_keys": (world, "SELECT k, v FROM twice", "k int, v string", "SELECT 1 AS k, 'new' AS v"),
    "json_repeated_item": (world, "SELECT n_name, n_name, n_nationkey FROM nations", "n_name string, n_nationkey int", "SELECT n_name, n_nationkey FROM nation"),
    "json_unknown_column": (world, "SELECT n_name, nothing.at.all AS x FROM nations", "n_name string, x string", "SELECT n_name, CAST(NULL AS VARCHAR) AS x FROM nation"),
    "json_comparisons": (world, "SELECT i FROM odd WHERE v = '2.50005' OR v = 2.5 OR v < -6.5 OR v = true", "i int", "SELECT unnest([6, 7, 10, 11]) AS i"),
    "json_not_two_valued": (world, "SELECT i FROM odd WHERE NOT (v > 0 OR v LIKE '%e%')", "i int", "SELECT unnest([2, 3, 4, 7, 8, 9, 10, 11, 12]) AS i"),
    "json_in_mixed": (world, "SELECT i FROM odd WHERE v IN (10, '2.5', 'zebra')", "i int", "SELECT unnest([1, 5, 6, 7]) AS i"),
    "json_null_or_missing": (world, "SELECT i FROM odd WHERE v IS NULL", "i int", "SELECT unnest([3, 4]) AS i"),
    "json_join_keys": (world, "SELECT a.i, b.i AS j FROM odd a JOIN odd b ON a.v = b.v", "i int, j int", "SELECT i, i AS j FROM (SELECT unnest([1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12]) AS i)"),
    "json_join_nested": (folder, "SELECT c.c_custkey, n.n_name FROM customers c JOIN nations n ON c.address.nation.key = n.n_nationkey", "c_custkey bigint, n_name string", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "json_join_files": (folder, "SELECT a.c_custkey, b.c_name FROM customers a LEFT JOIN customers b ON a.c_custkey = b.address.nation.key", "c_custkey bigint, c_name string", "SELECT a.c_custkey, b.c_name FROM customer a LEFT JOIN customer b ON a.c_custkey = b.c_nationkey"),
    "json_join_element": (world, "SELECT r.r_name, n.n_name FROM regions r JOIN nations n ON code = n.n_nationkey, UNNEST(r.info.codes.all) AS u(code)", "r_name string, n_name string", "SELECT r_name, n_name FROM (SELECT r_name, unnest([r_regionkey, r_regionkey + 10]) AS code FROM region WHERE r_regionkey > 1) JOIN nation ON code = n_nationkey"),
    "json_unnest_default": (world, "SELECT r_name, value FROM regions, UNNEST(info.codes.all) AS c", "r_name string, value int", "SELECT r_name, unnest([r_regionkey, r_regionkey + 10]) AS value FROM region WHERE r_regionkey > 1"),
    "json_unnest_objects": (world, "SELECT r_name, n.n_name FROM regions, UNNEST(nations) AS x(n) WHERE n.n_nationkey > 3", "r_name string, n_name string", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_nationkey > 3"),
    "json_unnest_chain": (world, "SELECT n.n_name, c FROM regions, UNNEST(nations) AS x(n), UNNEST(info.codes.all) AS y(c)", "n_name string, c int", "SELECT n_name, unnest([n_regionkey, n_regionkey + 10]) AS c FROM nation WHERE n_regionkey > 1"),
    "json_unnest_missing": (folder, "SELECT c_custkey, o.o_orderkey FROM customers, UNNEST(orders) AS x(o)", "c_custkey bigint, o_orderkey bigint", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"),
    "json_unnest_before_join": (folder, "SELECT n.n_name, o.o_orderkey FROM customers c, UNNEST(c.orders) AS x(o) JOIN nations n ON c.address.nation.key = n.n_nationkey WHERE o.o_totalprice > 250000", "n_name string, o_orderkey bigint", "SELECT n_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 250000"),
    "json_order_top": (folder, "SELECT TOP 25 c_custkey FROM customers ORDER BY address.nation.key DESC, c_acctbal, c_custkey", "c_custkey bigint", "SELECT c_custkey FROM customer ORDER BY c_nationkey DESC, c_acctbal, c_custkey LIMIT 25"),
    "json_cte_shadows": (world, "WITH nations AS (SELECT r_regionkey AS n_nationkey, r_name AS n_name FROM region_rows) SELECT n_nationkey, n_name FROM nations", NATION, "SELECT r_regionkey AS n_nationkey, r_name AS n_name FROM region"),
    "json_cte_twice": (world, "WITH low AS (SELECT n_nationkey, n_regionkey FROM nations WHERE n_nationkey < 12) SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM low a JOIN low b ON a.n_regionkey = b.n_regionkey", "x int, y int", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < 12 AND b.n_nationkey < 12"),
    "json_cte_limit": (world, "WITH s AS (SELECT n_nationkey, n_name FROM nations ORDER BY n_name DESC) SELECT n_nationkey, n_name FROM s LIMIT 6", NATION, "SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC LIMIT 6"),
}

#: Fixture, query, the one JSON text that it gives as SQL.
AS_TEXT: dict[str, tuple[Callable, str, str]] = {
    "json_compact_array": (world, "SELECT n_nationkey, n_name FROM nations", f"SELECT '[' || string_agg({_OBJECT}, ',' ORDER BY n_nationkey) || ']' AS json FROM nation"),
    "json_missing_and_null": (world, "SELECT i, v FROM odd WHERE i < 5", """SELECT '[{"i":1,"v":10},{"i":2,"v":"9 kg"},{"i":3},{"i":4,"v":null}]' AS json"""),
    "json_empty_rows": (world, "SELECT nothing FROM region_rows", "SELECT '[{},{},{},{},{}]' AS json"),
    "json_star_of_table": (world, "SELECT r.* FROM region_rows r", "SELECT '[{},{},{},{},{}]' AS json"),
    "json_expression_item": (world, "SELECT COUNT(*) FROM region_rows", "SELECT '[{},{},{},{},{}]' AS json"),
    "json_star_merges": (world, "SELECT * FROM nations n JOIN region_rows r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey = 3", """SELECT '[{"n_name":"' || n_name || '","n_nationkey":3,"n_regionkey":' || n_regionkey || ',"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}]' AS json FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3"""),
    "json_nested_value": (world, "SELECT r_name, info FROM regions WHERE r_regionkey > 2", """SELECT '[' || string_agg('{"r_name":"' || r_name || '","info":{"codes":{"all":[' || r_regionkey || ',' || (r_regionkey + 10) || ']}}}', ',' ORDER BY r_regionkey) || ']' AS json FROM region WHERE r_regionkey > 2"""),
    "json_order_mixed": (world, "SELECT i FROM odd ORDER BY v", """SELECT '[' || string_agg('{"i":' || i || '}', ',' ORDER BY k) || ']' AS json FROM (SELECT unnest([3, 10, 8, 9, 6, 7, 2, 1, 12, 4, 11, 5]) AS i, unnest(range(12)) AS k)"""),
    "json_order_mixed_down": (world, "SELECT i FROM odd ORDER BY v DESC", """SELECT '[' || string_agg('{"i":' || i || '}', ',' ORDER BY k) || ']' AS json FROM (SELECT unnest([5, 11, 4, 12, 1, 2, 6, 7, 9, 8, 10, 3]) AS i, unnest(range(12)) AS k)"""),
    "json_order_stable": (world, "SELECT n_nationkey, n_name FROM nations ORDER BY n_regionkey", f"SELECT '[' || string_agg({_OBJECT}, ',' ORDER BY n_regionkey, n_nationkey) || ']' AS json FROM nation"),
    "json_order_of_files": (world, "SELECT TOP 3 n_nationkey, n_name FROM nations", f"SELECT '[' || string_agg({_OBJECT}, ',' ORDER BY n_nationkey) || ']' AS json FROM nation WHERE n_nationkey < 3"),
    "json_distinct_nested": (world, "SELECT DISTINCT w FROM odd", """SELECT '[{},{"w":{"a":[1,2],"b":1}},{"w":null},{"w":{"a":[2,1]}}]' AS json"""),
    "json_distinct_first": (world, "SELECT DISTINCT n_regionkey FROM nations LIMIT 7", """SELECT '[' || string_agg('{"n_regionkey":' || n_regionkey || '}', ',' ORDER BY k) || ']' AS json FROM (SELECT n_regionkey, min(n_nationkey) AS k FROM nation WHERE n_nationkey < 7 GROUP BY n_regionkey)"""),
}


def _typed_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fixture, text, kinds, _ = TYPED[name]
    return lambda spark, sf_dir: _typed(fixture(spark, sf_dir).sql(text), kinds)


def _text_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fixture, text, _ = AS_TEXT[name]
    return lambda spark, sf_dir: _text(spark, fixture(spark, sf_dir).execute(text))


def stdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    with contextlib.redirect_stdout(to := io.StringIO()):
        emit(world(spark, sf_dir).execute("SELECT n_nationkey, n_name FROM nations WHERE n_nationkey < 3"))
    return _text(spark, to.getvalue().rstrip("\n"))


def file_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To a file in a new folder, over what it held before, by the driver."""
    with tempfile.TemporaryDirectory() as top, contextlib.redirect_stdout(io.StringIO()):
        file = Path(top) / "new" / "out.json"
        for below in (9, 3):
            emit(world(spark, sf_dir).execute(f"SELECT n_nationkey, n_name FROM nations WHERE n_nationkey < {below}"), str(file))
        return _text(spark, file.read_text())


def lines_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines by all tasks, read again through a mapping."""
    engine = folder(spark, sf_dir)
    engine.write("SELECT c_custkey, c_name FROM customers WHERE c_acctbal > 0", f"{engine.catalog.data_dir}/out")
    engine.catalog.mappings.entries["out"] = "lines:out"
    return _typed(engine.sql("SELECT c_custkey, c_name FROM out"), "c_custkey bigint, c_name string")


def pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    with contextlib.redirect_stdout(to := io.StringIO()):
        emit(world(spark, sf_dir).execute("SELECT r_regionkey, r_name FROM region_rows"), indent=True)
    return _text(spark, to.getvalue().rstrip("\n"))


#: What must be refused: queries over world(), by kind.
REFUSED = {
    "unmapped table": "SELECT a FROM unknown",
    "empty folder": "SELECT a FROM empty",
    "missing file": "SELECT a FROM gone",
    "malformed document": "SELECT k FROM broken",
    "right join": "SELECT a FROM nations n RIGHT JOIN regions r ON n.a = r.a",
    "cross join": "SELECT a FROM nations n CROSS JOIN regions r",
    "join without ON": "SELECT a FROM nations n JOIN regions r",
    "join on two equalities": "SELECT a FROM nations n JOIN regions r ON n.a = r.a AND n.b = r.b",
    "join on an inequality": "SELECT a FROM nations n JOIN regions r ON n.a < r.a",
    "unnest without alias": "SELECT a FROM regions, UNNEST(nations)",
    "union": "SELECT n_name FROM nations UNION SELECT r_name FROM regions",
    "later CTE": "WITH a AS (SELECT x FROM b), b AS (SELECT n_name AS x FROM nations) SELECT x FROM a",
    "parameter without value": "SELECT n_name FROM nations WHERE n_nationkey > ${low}",
    "nothing": "SELECT n_name FROM nations",
}


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, out = world(spark, sf_dir), []
    for what, text in REFUSED.items():
        try:
            engine.execute(text)
            out.append((what, False))
        except Exception:  # noqa: BLE001
            out.append((what, True))
    return spark.createDataFrame(out, "what string, refused boolean")


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings saved, changed and loaded again: name, file and path of each; blank ones are refused."""
    with tempfile.TemporaryDirectory() as top:
        file = Path(top) / "new" / "mappings.json"
        first = Mappings(file)
        for name, mapping in (("b", "$.old"), (" a ", "shop.json:$.data:x"), ("b", "$.items")):
            first.add(name, mapping)
        bad = 0
        for name, mapping in ((" ", "$"), ("c", "")):
            try:
                first.add(name, mapping)
            except ValueError:
                bad += 1
        again = Mappings(file)
        rows = [(n, again.file_of(n), again.path_of(n)) for n in again.all()] + [("listing", again.listing(), str(bad)), ("has", str(again.has("a")), str(again.get("z")))]
    return spark.createDataFrame(rows, "name string, file string, path string")


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved query, loaded again and run with and without its parameter."""
    with tempfile.TemporaryDirectory() as top:
        SavedQueries(f"{top}/queries.json").save("low", "SELECT n_nationkey, n_name FROM nations WHERE n_nationkey < ${most:3}")
        text = SavedQueries(f"{top}/queries.json").get("low")
    engine = world(spark, sf_dir)
    return _typed(engine.sql(text), NATION).unionAll(_typed(engine.sql(text, {"most": "2"}), NATION))


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults with colons and empty ones, fragments, names in order, no second substitution."""
    rows = [
        ("colon", replace_parameters("at ${t:10:30}")),
        ("empty", replace_parameters("[${x:}]")),
        ("fragment", replace_parameters("IN (${list})", {"list": "1, 2"})),
        ("once", replace_parameters("${a}", {"a": "${b}"})),
        ("names", ",".join(parameter_names("${b} ${a:1} ${b}"))),
    ]
    return spark.createDataFrame(rows, "what string, text string")


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """--add-mapping, --save-query NAME --query SQL, then --run-query with a parameter; the exit codes and what is printed."""
    data = world(spark, sf_dir).catalog.data_dir
    with tempfile.TemporaryDirectory() as top, contextlib.redirect_stdout(to := io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        own = ["-d", data, "-c", f"{top}/m.json", "--queries-file", f"{top}/q.json"]
        text = "SELECT r_name FROM r WHERE r_regionkey = ${k}"
        codes = [cli.main([*own, *more], spark) for more in (["--add-mapping", "r", "world.json:$.data.regions"], ["--save-query", "of", "--query", text], ["--run-query", "of", "--param", "k=2"], ["--run-query", "none"])]
    return spark.createDataFrame([(",".join(map(str, codes)), to.getvalue().strip().split("\n")[-1])], "codes string, printed string")


def wide_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a CTE beyond 2^53, where doubles are no longer exact."""
    from vellum.queries import engine

    own = engine(spark, sf_dir)
    own.catalog.register("wide", spark.range(10).select((F.lit(2**53) + F.col("id")).alias("i")))
    return own.sql("WITH c AS (SELECT i FROM wide ORDER BY i DESC) SELECT i FROM c LIMIT 3")


def odd_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are none, or beyond doubles."""
    from vellum.queries import engine

    return engine(spark, sf_dir).sql("SELECT n_nationkey FROM nation WHERE (n_regionkey < 1e400 AND NOT n_regionkey = 'inf' AND n_regionkey NOT IN ('nan', 3)) OR n_nationkey > 'Infinity'")


_SMALL = f"SELECT '[' || string_agg({_OBJECT}, ',' ORDER BY n_nationkey) || ']' AS json FROM nation WHERE n_nationkey < 3"
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "json_stdout": (stdout, _SMALL),
    "json_file_sink": (file_sink, _SMALL),
    "json_lines_sink": (lines_sink, "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0"),
    "json_pretty": (pretty, """SELECT '[' || chr(10) || string_agg('  {' || chr(10) || '    "r_regionkey": ' || r_regionkey || ',' || chr(10) || '    "r_name": "' || r_name || '"' || chr(10) || '  }', ',' || chr(10) ORDER BY r_regionkey) || chr(10) || ']' AS json FROM region"""),
    "json_refused": (refused, "SELECT * FROM (VALUES " + ", ".join(f"('{w}', {str(w != 'nothing').lower()})" for w in REFUSED) + ") AS t(what, refused)"),
    "catalog_mappings": (mappings, "SELECT * FROM (VALUES ('a', 'shop.json', '$.data:x'), ('b', NULL, '$.items'), ('listing', 'Table mappings:' || chr(10) || '  a -> shop.json:$.data:x' || chr(10) || '  b -> $.items', '2'), ('has', 'True', 'None')) AS t(name, file, path)"),
    "saved_queries": (saved, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 2"),
    "parameters": (parameters, "SELECT * FROM (VALUES ('colon', 'at 10:30'), ('empty', '[]'), ('fragment', 'IN (1, 2)'), ('once', '${b}'), ('names', 'b,a')) AS t(what, text)"),
    "command_line": (command_line, """SELECT '0,0,0,1' AS codes, '[{"r_name":"' || r_name || '"}]' AS printed FROM region WHERE r_regionkey = 2"""),
    "cte_order_wide": (wide_order, "SELECT 9007199254740992 + k AS i FROM (SELECT unnest([9, 8, 7]) AS k)"),
    "filter_odd_literals": (odd_literals, "SELECT n_nationkey FROM nation WHERE n_regionkey <> 3"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _typed_query(k) for k in TYPED} | {k: _text_query(k) for k in AS_TEXT} | {k: f for k, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: x[3] for k, x in TYPED.items()} | {k: x[2] for k, x in AS_TEXT.items()} | {k: s for k, (_, s) in OTHERS.items()}
