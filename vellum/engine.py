"""The engine: query text in, DataFrame or JSON text out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.relation import Relation
from vellum.params import replace_parameters
from vellum.plans import dialect
from vellum.plans.compiler import Compiler
from vellum.session import configure
from vellum.sources.catalog import Catalog, Mappings


class Engine:
    """mode compat passes over in silence what the dialect ignores; strict raises UnsupportedError."""

    def __init__(self, spark: SparkSession, mappings: Mappings | None = None, data_dir: str = ".", mode: str = "compat"):
        if mode not in ("compat", "strict"):
            raise ValueError(f"no such mode: {mode}")
        self.spark = configure(spark)
        self.catalog = Catalog(self.spark, mappings, data_dir)
        self.strict = mode == "strict"

    def relation(self, text: str, params: dict[str, str] | None = None) -> Relation:
        query = dialect.parse(replace_parameters(text, params or {}))
        return Compiler(self.catalog, self.strict).compile(query)

    def sql(self, text: str, params: dict[str, str] | None = None) -> DataFrame:
        """The result with a column for each output field; SELECT * over untyped rows has one, named row."""
        relation = self.relation(text, params)
        b = relation.bindings[0]
        if b.column:
            return relation.df.select(F.col(b.column).alias("row"))
        return relation.df.select(*[F.col(c).alias(f) for f, c, _ in b.fields])

    def json_rows(self, text: str, params: dict[str, str] | None = None) -> DataFrame:
        """A JSON object in text for each row: what is missing is left out, an explicit null stays."""
        relation = self.relation(text, params)
        out = relation.df.orderBy(*relation.order) if relation.order else relation.df
        return out.select(_json(relation).alias("value"))

    def execute(self, text: str, params: dict[str, str] | None = None) -> str:
        """The result as one compact JSON array; for results of any size, write json_rows() instead."""
        return "[" + ",".join(r.value for r in self.json_rows(text, params).collect()) + "]"

    def write(self, text: str, path: str, params: dict[str, str] | None = None) -> None:
        """The result as JSON lines, by all tasks."""
        self.json_rows(text, params).write.mode("overwrite").text(path)


def _json(relation: Relation) -> Column:
    b = relation.bindings[0]
    if b.column:
        return F.to_json(F.col(b.column))
    fields = [(f, c, t) for f, c, t in b.fields if not isinstance(t, T.NullType)]
    if not fields:
        return F.lit("{}")
    return F.to_json(F.struct(*[F.col(c).alias(f) for f, c, _ in fields]))


