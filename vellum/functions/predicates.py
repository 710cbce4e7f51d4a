"""Predicates as Columns.

Logic has two values: what is missing or null makes an atom false. Atoms are emitted bare in positive places, so
that the optimiser can push them into scans and infer null checks; NOT is pushed down to the atoms,
and only there NULL is turned into false.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.errors import UnsupportedError
from vellum.functions import values as V
from vellum.functions.values import Value
from vellum.plans import ir

TOLERANCE = 1e-4
Resolve = Callable[[str], Value | None]


def compile_predicate(node, resolve: Resolve, strict: bool = False, negated: bool = False) -> Column:
    if isinstance(node, ir.Not):
        return compile_predicate(node.inner, resolve, strict, not negated)
    if isinstance(node, (ir.And, ir.Or)):
        left, right = (compile_predicate(n, resolve, strict, negated) for n in (node.left, node.right))
        return left & right if isinstance(node, ir.And) != negated else left | right
    if isinstance(node, ir.Unsupported) and strict:
        raise UnsupportedError(f"Unsupported predicate: {node.text}")
    c = _atom(node, resolve)
    return ~F.coalesce(c, F.lit(False)) if negated else c


def _atom(node, resolve: Resolve) -> Column:
    if isinstance(node, ir.Unsupported):
        return F.lit(False)
    value = resolve(node.path)
    if isinstance(node, ir.IsNull):
        return _is_null(value, node.negated)
    if value is None:
        return F.lit(False)
    if isinstance(node, ir.Compare):
        return _compare(value, node.op, node.literal)
    if isinstance(node, ir.Like):
        return _like(value, node)
    hits = [_equal(value, x) for x in node.literals]
    found = _isin(value, node.literals)
    if found is None:
        found = F.lit(False)
        for h in hits:
            found = found | h
    return _present(value) & ~F.coalesce(found, F.lit(False)) if node.negated else found


def _isin(value: Value, literals: tuple[ir.Literal, ...]) -> Column | None:
    """A plain IN where equality is plain; scans can take it."""
    if value.string and literals:
        return value.col.isin([x.text for x in literals])
    whole = [_whole(x.number) for x in literals]
    if value.integral and literals and None not in whole:
        return value.col.isin(whole)
    return None


def _whole(x: float | None) -> int | None:
    """A number as an integer where it is one that doubles hold exactly."""
    return int(x) if x is not None and abs(x) < 2**53 and x == int(x) else None


def _is_null(value: Value | None, negated: bool) -> Column:
    if value is None:
        return F.lit(negated is False)
    if value.variant:
        return _present(value) if negated else value.col.isNull() | F.is_variant_null(value.col)
    return value.col.isNotNull() if negated else value.col.isNull()


def _present(value: Value) -> Column:
    return value.col.isNotNull() & ~F.is_variant_null(value.col) if value.variant else value.col.isNotNull()


def _near(number: Column, x: float) -> Column:
    return (number > x - TOLERANCE) & (number < x + TOLERANCE)


def _equal(value: Value, literal: ir.Literal) -> Column:
    x, truth = literal.number, literal.text.lower() == "true"
    if value.variant:
        v = value.col
        number = _near(V.number_of(v), x) if x is not None and math.isfinite(x) else F.lit(False)
        return (
            F.when(V.is_string(v), V.string_of(v) == literal.text)
            .when(V.is_number(v), number)
            .when(V.is_boolean(v), F.try_variant_get(v, "$", "boolean") == truth)
            .otherwise(False)
        )
    if value.string:
        return value.col == literal.text
    if value.boolean:
        return value.col == truth
    if value.numeric:
        if x is None or not math.isfinite(x):
            return F.lit(False)
        if value.integral and (n := _whole(x)) is not None:
            return value.col == n
        return _near(value.col, x)
    if value.time:
        return value.col == F.lit(literal.text).try_cast(value.type)
    return F.lit(False)


def _ordered(value: Value, op: str, literal: ir.Literal) -> Column:
    """< and >: of numbers only (and of dates and times, in typed sources)."""
    x = literal.number
    if value.time:
        bound = F.lit(literal.text).try_cast(value.type)
        return value.col > bound if op == ">" else value.col < bound
    if x is None or x != x or not (value.variant or value.numeric):
        return F.lit(False)
    number = V.number_of(value.col) if value.variant else value.col
    whole = _whole(x) if value.integral else None
    bound = x if whole is None else whole
    return number > bound if op == ">" else number < bound


def _compare(value: Value, op: str, literal: ir.Literal) -> Column:
    if op == "=":
        return _equal(value, literal)
    if op == "!=":
        return _present(value) & ~F.coalesce(_equal(value, literal), F.lit(False))
    if op in "<>":
        return _ordered(value, op, literal)
    x = literal.number
    if value.integral and (n := _whole(x)) is not None:
        return value.col >= n if op == ">=" else value.col <= n
    return _ordered(value, op[0], literal) | _equal(value, literal)


def like_pattern(pattern: str) -> str:
    """A regular expression for LIKE: % any run, _ any character, all else as it is; line ends are not crossed."""
    body = "".join(".*" if c == "%" else "." if c == "_" else re.sub(r"([^\w\s])", r"\\\1", c) for c in pattern)
    return rf"\A(?:{body})\z"


def _like(value: Value, node: ir.Like) -> Column:
    if not (value.variant or value.string):
        return F.lit(False)
    text = V.string_of(value.col) if value.variant else value.col
    pattern = node.pattern.lower() if node.ignore_case else node.pattern
    hit = (F.lower(text) if node.ignore_case else text).rlike(like_pattern(pattern))
    if node.negated:
        return text.isNotNull() & ~hit
    head = re.match(r"[^%_]*", pattern).group()
    return text.startswith(head) & hit if head and not node.ignore_case and value.string else hit
