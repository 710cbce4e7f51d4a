"""A query's plan: FROM, UNNEST, JOIN, WHERE, ORDER BY, LIMIT, projection and, last, DISTINCT."""

from __future__ import annotations

from dataclasses import replace

from vellum.errors import UnsupportedError
from vellum.operators import shape
from vellum.operators.join import join
from vellum.operators.relation import Relation
from vellum.operators.unnest import unnest
from vellum.plans import ir


class Compiler:
    """catalog has scan(name, binding, serial) -> Relation; strict refuses what compat passes over in silence."""

    def __init__(self, catalog, strict: bool = False):
        self.catalog, self.strict = catalog, strict
        self.scope: dict[str, Relation] = {}
        self.serial = 0

    def compile(self, query: ir.Query) -> Relation:
        for name, body in query.ctes:
            self.scope[name] = self.select(body, name, inner=True)
        return self.select(query, "result")

    def scan(self, table: ir.Table) -> Relation:
        self.serial += 1000
        if table.name in self.scope:
            return self.again(self.scope[table.name], table.binding)
        return self.catalog.scan(table.name, table.binding, self.serial)

    def again(self, relation: Relation, name: str) -> Relation:
        """A CTE's result under a new name, with column names of its own."""
        binding, old = relation.bindings[0], relation.df.columns
        new = {c: f"{c.split('_')[0][0]}{self.serial}_{k}" for k, c in enumerate(old)}
        df = relation.df.toDF(*[new[c] for c in old])
        column = new[binding.column] if binding.column else None
        moved = replace(binding, name=name, column=column, fields=tuple((f, new[c], t) for f, c, t in binding.fields), present=None)
        return Relation(df, (moved,), tuple(new[c] for c in relation.order), self.serial + 1)

    def select(self, query: ir.Query, name: str, inner: bool = False) -> Relation:
        if self.strict and query.ignored:
            raise UnsupportedError(f"Unsupported clauses: {', '.join(query.ignored)}")
        relation = self.scan(query.table)
        for u in query.unnests:
            relation = unnest(relation, u.path, u.column)
        for j in query.joins:
            relation = join(relation, self.scan(j.table), j.kind, j.left, j.right)
        if query.where is not None:
            relation = shape.keep(relation, query.where, self.strict)
        if query.order and (inner or query.distinct):
            relation = shape.carried(relation, query.order)
            if query.limit is not None:
                relation = shape.ordered(relation, (), query.limit)
        elif query.order or query.limit is not None:
            relation = shape.ordered(relation, query.order, query.limit)
        if query.order and not inner and not query.distinct:
            relation = replace(relation, order=())
        self.serial = max(self.serial, relation.serial)
        out = shape.output(relation, query, name, self.strict)
        return shape.distinct(out) if query.distinct else out
