"""UNNEST: a row for each element of an array; rows without one go."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import values as V
from vellum.operators.relation import Binding, Relation, columns, place


def unnest(relation: Relation, path: str, name: str) -> Relation:
    value, serial = relation.resolve(path), relation.serial
    element, at = f"u{serial}", f"o{serial}_0"
    if value is not None and value.variant:
        array, kind = F.when(V.is_array(value.col), value.col).cast("array<variant>"), T.VariantType()
    elif value is not None and isinstance(value.type, T.ArrayType):
        array, kind = value.col, value.type.elementType
    else:
        array, kind = F.lit(None).cast("array<string>"), T.StringType()
    df = relation.df.select(*columns(relation.df), F.posexplode(array).alias(at, element))
    if not relation.order:
        df = df.drop(at)
    return Relation(df, place(relation, Binding(name, element, kind)), (*relation.order, at) if relation.order else (), serial + 1)
