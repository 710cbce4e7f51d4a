"""Values of a path: a Column with what is known of its type, and the keys made from it.

A value's type is a Spark type, or VariantType where it is known per row only. SQL NULL stands for
a missing value; an explicit JSON null is a variant null, which is not NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTION = (T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType

    @property
    def variant(self) -> bool:
        return isinstance(self.type, T.VariantType)

    @property
    def integral(self) -> bool:
        return isinstance(self.type, _INTEGRAL)

    @property
    def numeric(self) -> bool:
        return isinstance(self.type, (*_INTEGRAL, *_FRACTION))

    @property
    def string(self) -> bool:
        return isinstance(self.type, (T.StringType, T.CharType, T.VarcharType))

    @property
    def boolean(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def time(self) -> bool:
        return isinstance(self.type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def quoted(key: str) -> str:
    """A key in a variant path."""
    return f"['{key}']" if '"' in key else f'["{key}"]'


def child(value: Value, key: str) -> Value | None:
    """A field of an object; None where the type says that there is none."""
    if value.variant:
        if '"' in key and "'" in key:
            return None
        return Value(F.try_variant_get(value.col, "$" + quoted(key), "variant"), T.VariantType())
    if isinstance(value.type, T.StructType):
        found = next((f for f in value.type.fields if f.name == key), None)
        return Value(value.col.getField(key), found.dataType) if found else None
    if isinstance(value.type, T.MapType) and isinstance(value.type.keyType, T.StringType):
        return Value(F.try_element_at(value.col, F.lit(key)), value.type.valueType)
    return None


def descend(value: Value | None, keys: list[str]) -> Value | None:
    for key in keys:
        if value is None:
            return None
        value = child(value, key)
    return value


# -- variants by kind


def kind(v: Column) -> Column:
    """BIGINT, DOUBLE, DECIMAL(p,s), STRING, BOOLEAN, VOID, OBJECT<...>, ARRAY<...>; NULL if missing."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return kind(v).startswith("OBJECT")


def is_array(v: Column) -> Column:
    return kind(v).startswith("ARRAY")


def is_whole(v: Column) -> Column:
    return kind(v) == "BIGINT"


def is_number(v: Column) -> Column:
    return (kind(v) == "BIGINT") | (kind(v) == "DOUBLE") | kind(v).startswith("DECIMAL") | (kind(v) == "FLOAT")


def is_string(v: Column) -> Column:
    return kind(v) == "STRING"


def is_boolean(v: Column) -> Column:
    return kind(v) == "BOOLEAN"


def number_of(v: Column) -> Column:
    return F.when(is_number(v), F.try_variant_get(v, "$", "double"))


def string_of(v: Column) -> Column:
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


def as_variant(value: Value) -> Column:
    if value.variant:
        return value.col
    if isinstance(value.type, (T.StructType, T.MapType, T.ArrayType)):
        return F.parse_json(F.to_json(value.col))
    if isinstance(value.type, T.NullType):
        return F.lit(None).cast("variant")
    return value.col.cast("variant")


# -- keys


def join_key(value: Value) -> Column:
    """Text that is equal for equal values of one kind: 1, 1.0 and '1' differ, null equals null."""
    if value.variant:
        v = value.col
        return (
            F.when(v.isNull(), F.lit(None).cast("string"))
            .when(F.is_variant_null(v), F.lit("N"))
            .when(is_whole(v), F.concat(F.lit("I:"), F.try_variant_get(v, "$", "string")))
            .when(is_number(v), F.concat(F.lit("F:"), number_of(v).cast("string")))
            .when(is_string(v), F.concat(F.lit("S:"), F.try_variant_get(v, "$", "string")))
            .when(is_boolean(v), F.concat(F.lit("B:"), F.try_variant_get(v, "$", "string")))
            .otherwise(F.concat(F.lit("J:"), F.to_json(v)))
        )
    mark = "I:" if value.integral else "F:" if value.numeric else "B:" if value.boolean else "S:" if value.string or value.time else "J:"
    body = F.to_json(value.col) if mark == "J:" else value.col.cast("double").cast("string") if mark == "F:" else value.col.cast("string")
    return F.concat(F.lit(mark), body)


def _numeric_part(text: Column) -> Column:
    """The number that a text is, or begins with; NULL without one."""
    t = F.trim(text)
    whole = F.when(t.rlike("[nN]"), F.lit(None).cast("double")).otherwise(t.try_cast("double"))
    return F.coalesce(whole, F.regexp_extract(t, "^[0-9.+-]+", 0).try_cast("double"))


def sort_keys(value: Value | None, descending: bool) -> list[Column]:
    """Sort expressions: missing first, numbers by value, texts by a number that they begin with, else as text."""
    if value is None:
        return []
    direct = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_first())
    if value.numeric or value.boolean or value.time:
        return [direct(value.col)]
    if value.variant:
        v = value.col
        text = F.when(v.isNull(), F.lit(None).cast("string")).when(F.is_variant_null(v), F.lit("null")).when(is_object(v) | is_array(v), F.lit("")).otherwise(F.try_variant_get(v, "$", "string"))
        number = F.coalesce(number_of(v), _numeric_part(text))
    elif value.string:
        text, number = value.col, _numeric_part(value.col)
    else:
        text, number = F.when(value.col.isNotNull(), F.lit("")), F.lit(None).cast("double")
    #: A text without a number stands against numbers as text: before "-0..." ahead of all, before "0" between those below 0 and the rest.
    group = F.when(text.isNull(), 0).when(number.isNotNull(), 2).when(text < "-0", 1).when(text < "0", 2).otherwise(3)
    place = F.coalesce(number, F.when(group == 2, F.lit(-5e-324)))
    return [direct(group), direct(place), direct(F.when(number.isNull(), text))]
