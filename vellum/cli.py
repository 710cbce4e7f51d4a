"""Command line: python -m vellum.cli --query "SELECT ..." """

from __future__ import annotations

import argparse
import os
import sys
import traceback

from vellum.output import emit
from vellum.params import parameter_names
from vellum.saved import SavedQueries
from vellum.sources.catalog import Mappings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellum", description="SQL over JSON documents and Parquet tables.")
    p.add_argument("-q", "--query", help="query to run")
    p.add_argument("-d", "--data-dir", default=".", help="folder of the data files")
    p.add_argument("-c", "--config", default="mappings.json", help="file of the table mappings")
    p.add_argument("--queries-file", default="queries.json", help="file of the saved queries")
    p.add_argument("-o", "--output", help="file for the result")
    p.add_argument("--clipboard", action="store_true", help="copy the result")
    p.add_argument("--pretty", action="store_true", help="indent the result")
    p.add_argument("--strict", action="store_true", help="refuse what the dialect would ignore")
    p.add_argument("--list-tables", action="store_true")
    p.add_argument("--add-mapping", nargs=2, metavar=("TABLE", "PATH"))
    p.add_argument("--list-queries", action="store_true")
    p.add_argument("--save-query", nargs="+", metavar="NAME", help="save --query, or a second value, under a name")
    p.add_argument("--delete-query", metavar="NAME")
    p.add_argument("--run-query", metavar="NAME")
    p.add_argument("--param", action="append", default=[], metavar="KEY=VALUE")
    return p


def parse_params(pairs: list[str]) -> dict[str, str]:
    out = {}
    for pair in pairs:
        key, eq, value = pair.partition("=")
        if not eq or not key.strip():
            raise ValueError(f"Invalid parameter: {pair}. Use key=value")
        out[key.strip()] = value.strip()
    return out


def run(args: argparse.Namespace, spark=None) -> int:
    mappings = Mappings(args.config)
    if args.list_tables:
        print(mappings.listing())
        return 0
    if args.add_mapping:
        mappings.add(*args.add_mapping)
        print(f"Mapping added: {args.add_mapping[0]} -> {args.add_mapping[1]}")
        return 0
    saved = SavedQueries(args.queries_file)
    if args.list_queries:
        print(saved.listing())
        return 0
    if args.save_query:
        name, *text = args.save_query
        if len(text) > 1 or not (text or args.query):
            raise ValueError("--save-query takes a name and one query, which --query gives")
        saved.save(name, text[0] if text else args.query)
        print(f"Query saved: {args.save_query[0]}")
        return 0
    if args.delete_query:
        saved.delete(args.delete_query)
        print(f"Query deleted: {args.delete_query}")
        return 0
    text = args.query
    if args.run_query:
        if not saved.has(args.run_query):
            raise ValueError(f"Query not found: {args.run_query}")
        text = saved.get(args.run_query)
        print(f"Running query: {text}", file=sys.stderr)
    if not text:
        raise ValueError("Nothing to do: give --query, --run-query or one of the list options")
    params = parse_params(args.param)
    if unknown := set(params) - set(parameter_names(text)):
        print(f"Unused parameters: {', '.join(sorted(unknown))}", file=sys.stderr)
    from pyspark.sql import SparkSession

    from vellum.engine import Engine

    spark = spark or SparkSession.builder.appName("vellum").getOrCreate()
    engine = Engine(spark, mappings, args.data_dir, "strict" if args.strict else "compat")
    emit(engine.execute(text, params), args.output, args.clipboard, args.pretty)
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, spark)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
    except Exception as e:  # noqa: BLE001
        print(f"Error executing query: {e}", file=sys.stderr)
        if os.environ.get("DEBUG"):
            traceback.print_exc()
    return 1


if __name__ == "__main__":
    sys.exit(main())
