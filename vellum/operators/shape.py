"""What follows the joins: filter, order, limit, projection, distinct."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import UnsupportedError
from vellum.functions import values as V
from vellum.functions.predicates import compile_predicate
from vellum.functions.values import Value
from vellum.operators.relation import Binding, Relation, columns
from vellum.plans import ir


def keep(relation: Relation, where, strict: bool) -> Relation:
    return replace(relation, df=relation.df.filter(compile_predicate(where, relation.resolve, strict)))


def sort_columns(relation: Relation, order: tuple[ir.Order, ...]) -> list[Column]:
    keys = [k for o in order for k in V.sort_keys(relation.resolve(o.path), o.descending)]
    return [*keys, *[F.col(c).asc() for c in relation.order]]


def ordered(relation: Relation, order: tuple[ir.Order, ...], limit: int | None) -> Relation:
    """Rows by the order and their place; with a limit, the first of them."""
    keys = sort_columns(relation, order)
    df = relation.df.orderBy(*keys) if keys and (order or limit is not None) else relation.df
    return replace(relation, df=df if limit is None else df.limit(limit))


def renumbered(relation: Relation, order: tuple[ir.Order, ...]) -> Relation:
    """The sort keys become the rows' ordinals, so that an outer LIMIT sees this order."""
    names, picked, serial = [], [], relation.serial
    for o in order:
        value = relation.resolve(o.path)
        #: Ascending stand-ins for the sort expressions.
        for k, key in enumerate(_ranks(value, o.descending)):
            names.append(f"k{serial}_{len(names)}")
            picked.append(key.alias(names[-1]))
    df = relation.df.select(*columns(relation.df), *picked)
    return Relation(df, relation.bindings, (*names, *relation.order), serial + 1)


def _ranks(value: Value | None, descending: bool) -> list[Column]:
    """Sort keys whose ascending order, NULL first, is the wanted one; texts can only ascend."""
    if value is None:
        return []
    if value.numeric or value.boolean or value.time:
        #: Longs are turned round by their bits, which loses none of them.
        n = F.unix_micros(value.col.cast("timestamp")) if value.time else value.col.cast("long") if value.boolean or value.integral else value.col
        back = F.bitwise_not(n) if value.time or value.boolean or value.integral else -n
        return [F.when(value.col.isNull(), 1).otherwise(0), back] if descending else [n]
    raise UnsupportedError("ORDER BY of a text inside a CTE can't be carried on as numbers")


def carried(relation: Relation, order: tuple[ir.Order, ...]) -> Relation:
    """As renumbered(), for any key: where a key isn't a number, rows get a running number from a global sort."""
    try:
        return renumbered(relation, order)
    except UnsupportedError:
        name = f"k{relation.serial}_0"
        df = relation.df.orderBy(*sort_columns(relation, order))
        #: Range partitions of a sort are in order, so their running ids are, too.
        df = df.select(*columns(df), F.monotonically_increasing_id().alias(name))
        return Relation(df, relation.bindings, (name,), relation.serial + 1)


def star_fields(relation: Relation) -> list[tuple[str, Value]] | None:
    """Fields of SELECT *, later bindings over earlier ones; None where they are known per row only."""
    out: dict[str, Value] = {}
    for b in relation.bindings:
        if b.column is None:
            out |= {f: Value(F.col(c), t) for f, c, t in b.fields}
        elif isinstance(b.type, T.StructType):
            out |= {f.name: Value(F.col(b.column).getField(f.name), f.dataType) for f in b.type.fields}
        elif isinstance(b.type, T.VariantType):
            return None
        else:
            out[b.name] = b.whole()
    return list(out.items())


def star_variant(relation: Relation) -> Column:
    """All fields of a row in one object; a binding that isn't an object stays under its name."""
    maps = []
    for b in relation.bindings:
        v = V.as_variant(b.whole())
        flat = F.when(V.is_object(v), v).cast("map<string,variant>")
        own = F.when(v.isNotNull() & ~V.is_object(v), F.create_map(F.lit(b.name), v))
        maps.append(F.coalesce(flat, own, F.create_map().cast("map<string,variant>")))
    return F.to_variant_object(F.map_concat(*maps)) if len(maps) > 1 else F.to_variant_object(maps[0])


def item_names(items: tuple[ir.Item, ...]) -> list[str]:
    """Output names: aliases and last path parts; parts that would collide give way to whole paths."""
    often = Counter(i.name for i in items)
    return [i.text if often[i.name] > 1 and not i.alias else i.name for i in items]


def projected(relation: Relation, query: ir.Query, strict: bool) -> tuple[list[tuple[str, Value]] | None, Column | None]:
    """The output's fields; or one object column for SELECT * over rows of no known type."""
    if query.star:
        fields = star_fields(relation)
        return (fields, None) if fields is not None else (None, star_variant(relation))
    out: dict[str, Value] = {}
    for item, name in zip(query.items, item_names(query.items), strict=True):
        value = relation.resolve(item.text)
        if strict and re.search(r"[()*+'|%,/]|\s", item.text):
            raise UnsupportedError(f"Unsupported expression in SELECT: {item.text}")
        out[name] = value or Value(F.lit(None).cast("string"), T.StringType())
    return list(out.items()), None


def distinct(relation: Relation) -> Relation:
    """The first of equal rows. relation has one binding: the output."""
    binding = relation.bindings[0]
    values = [binding.whole()] if binding.column else [Value(F.col(c), t) for _, c, t in binding.fields]
    plain = not any(v.variant or isinstance(v.type, (T.MapType, T.ArrayType, T.StructType)) for v in values)
    if plain and not relation.order:
        return replace(relation, df=relation.df.dropDuplicates(binding.columns))
    keys = [V.join_key(v).alias(f"d{k}") for k, v in enumerate(values)]
    row = F.struct(*[F.col(c) for c in relation.df.columns])
    first = F.min_by(row, F.struct(*relation.order)) if relation.order else F.first(row)
    out = relation.df.groupBy(*keys).agg(first.alias("row")).select("row.*")
    return replace(relation, df=out)


def output(relation: Relation, query: ir.Query, name: str, strict: bool) -> Relation:
    """The projection as a relation of one binding."""
    fields, whole = projected(relation, query, strict)
    serial, ordinals = relation.serial, [F.col(c) for c in relation.order]
    if whole is not None:
        return Relation(relation.df.select(whole.alias(f"v{serial}"), *ordinals), (Binding(name, f"v{serial}", T.VariantType()),), relation.order, serial + 1)
    made = tuple((f, f"c{serial}_{k}", v.type) for k, (f, v) in enumerate(fields))
    df = relation.df.select(*[v.col.alias(c) for (_, v), (_, c, _) in zip(fields, made, strict=True)], *ordinals)
    return Relation(df, (Binding(name, fields=made),), relation.order, serial + 1)
