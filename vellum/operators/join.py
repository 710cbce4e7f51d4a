"""Inner and left equi-joins on one equality."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import values as V
from vellum.functions.values import Value
from vellum.operators.relation import Relation, place


def _sides(left: Relation, right: Relation, first: str, second: str) -> tuple[Value | None, Value | None]:
    """The operands' values, first in the left and second in the right relation, or the other way round."""
    a, b = left.resolve(first), right.resolve(second)
    name = right.bindings[0].name
    swapped = first.split(".")[0] == name and second.split(".")[0] != name
    if swapped or a is None or b is None:
        c, d = left.resolve(second), right.resolve(first)
        if c is not None and d is not None:
            return c, d
    return a, b


def _condition(a: Value | None, b: Value | None) -> Column:
    if a is None or b is None:
        return F.lit(False)
    if not a.variant and not b.variant:
        same = a.numeric and b.numeric or a.string and b.string or a.boolean and b.boolean or a.time and b.time
        return a.col == b.col if same or a.type == b.type else F.lit(False)
    return V.join_key(a) == V.join_key(b)


def join(left: Relation, right: Relation, kind: str, first: str, second: str) -> Relation:
    """right has one binding, and column names that left hasn't."""
    a, b = _sides(left, right, first, second)
    binding, df = right.bindings[0], right.df
    if kind == "left" and binding.column is None:
        binding = replace(binding, present=f"p{right.serial}")
        df = df.withColumn(binding.present, F.lit(True))
    out = left.df.join(df, _condition(a, b), kind)
    return Relation(out, place(left, binding), (*left.order, *right.order), max(left.serial, right.serial) + 1)
