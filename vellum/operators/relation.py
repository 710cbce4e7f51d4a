"""A relation: a DataFrame, what its columns mean, and in which order its rows stand.

A binding is a name at the top of a row: a table, an unnested element. Its values are either one column
(a variant, or an element of a known type) or a column for each field, as typed sources have them; the latter
keep column pruning and filter pushdown as they are for any DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import values as V
from vellum.functions.values import Value


@dataclass(frozen=True)
class Binding:
    name: str
    column: str | None = None  # of a variant or element
    type: T.DataType | None = None
    fields: tuple[tuple[str, str, T.DataType], ...] = ()  # field, column, type
    present: str | None = None  # a column that is NULL where an outer join found nothing

    @property
    def columns(self) -> list[str]:
        return [c for c in (self.column, *(c for _, c, _ in self.fields), self.present) if c]

    @property
    def object(self) -> bool:
        """Whether fields can be looked up in it."""
        return self.column is None or isinstance(self.type, (T.StructType, T.VariantType, T.MapType))

    def whole(self) -> Value:
        """The value of the bare name."""
        if self.column:
            return Value(F.col(self.column), self.type)
        col = F.struct(*[F.col(c).alias(f) for f, c, _ in self.fields])
        if self.present:
            col = F.when(F.col(self.present).isNotNull(), col)
        return Value(col, T.StructType([T.StructField(f, t) for f, _, t in self.fields]))

    def find(self, keys: list[str]) -> Value | None:
        if self.column:
            return V.descend(Value(F.col(self.column), self.type), keys)
        for f, c, t in self.fields:
            if f == keys[0]:
                return V.descend(Value(F.col(c), t), keys[1:])
        return None


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    bindings: tuple[Binding, ...]
    order: tuple[str, ...] = ()  # ordinal columns, most significant first
    serial: int = field(default=0)  # for fresh column names

    def resolve(self, path: str) -> Value | None:
        """The value of a path: from the row's top if it names a binding, else in the first binding that has it."""
        keys = path.split(".")
        found: list[Value] = []
        top = next((b for b in self.bindings if b.name == keys[0]), None)
        if top is not None:
            value = top.find(keys[1:]) if len(keys) > 1 else top.whole()
            if value is not None:
                found.append(value)
        for b in self.bindings if not (found and not found[0].variant) else ():
            if not b.object:
                continue
            for tried in ([path], keys) if len(keys) > 1 else (keys,):
                value = b.find(tried)
                if value is not None:
                    found.append(value)
            if found and not found[-1].variant:
                break
        return _first_present(found)


def _first_present(found: list[Value]) -> Value | None:
    """Of alternatives, per row, the first that isn't missing; a typed one ends the search."""
    if len(found) < 2 or not found[0].variant:
        return found[0] if found else None
    upto = next((k for k, v in enumerate(found) if not v.variant), len(found) - 1)
    return Value(F.coalesce(*[V.as_variant(v) for v in found[: upto + 1]]), T.VariantType())


def from_frame(df: DataFrame, name: str, serial: int = 0) -> Relation:
    """A typed DataFrame as a binding with a column for each of its fields."""
    fields = tuple((f.name, f"c{serial}_{k}", f.dataType) for k, f in enumerate(df.schema.fields))
    renamed = df.select(*[F.col(f"`{f.name}`").alias(c) for f, (_, c, _) in zip(df.schema.fields, fields, strict=True)])
    return Relation(renamed, (Binding(name, fields=fields),), (), serial + 1)


def from_variants(df: DataFrame, name: str, column: str, order: tuple[str, ...], serial: int = 0) -> Relation:
    """A DataFrame with an object in a variant column, and ordinals."""
    own, ordinals = f"v{serial}", tuple(f"o{serial}_{k}" for k in range(len(order)))
    renamed = df.select(F.col(column).alias(own), *[F.col(c).alias(o) for c, o in zip(order, ordinals, strict=True)])
    return Relation(renamed, (Binding(name, own, T.VariantType()),), ordinals, serial + 1)


def place(relation: Relation, binding: Binding) -> tuple[Binding, ...]:
    """Bindings with one more; a name that is there already is taken over in its place."""
    names = [b.name for b in relation.bindings]
    if binding.name in names:
        return tuple(binding if b.name == binding.name else b for b in relation.bindings)
    return (*relation.bindings, binding)


def columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]
