"""The intermediate form of a query: plain data, nothing of Spark."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Item:
    """A SELECT item: the text of its expression, and its alias."""

    text: str
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or self.text.rsplit(".", 1)[-1]


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None

    @property
    def binding(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Unnest:
    path: str
    alias: str
    column: str = "value"


@dataclass(frozen=True)
class Join:
    table: Table
    kind: str  # inner or left
    left: str
    right: str


@dataclass(frozen=True)
class Literal:
    """A literal's text as comparisons see it, and whether it was written as a number."""

    text: str
    numeric: bool = False

    @property
    def number(self) -> float | None:
        """What the text is as a double; of the names of no finite number, Infinity and NaN in this case only."""
        text = self.text.strip()
        if "_" in text or ("n" in text.lower() and text.lstrip("+-") not in ("Infinity", "NaN")):
            return None
        try:
            return float(text) if text else None
        except ValueError:
            return None


@dataclass(frozen=True)
class Compare:
    path: str
    op: str  # = != < <= > >=
    literal: Literal


@dataclass(frozen=True)
class Like:
    path: str
    pattern: str
    negated: bool = False
    ignore_case: bool = False


@dataclass(frozen=True)
class In:
    path: str
    literals: tuple[Literal, ...]
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    path: str
    negated: bool = False


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Unsupported:
    """A predicate that the dialect doesn't know: never true."""

    text: str


@dataclass(frozen=True)
class Order:
    path: str
    descending: bool = False


@dataclass(frozen=True)
class Query:
    items: tuple[Item, ...]
    table: Table
    unnests: tuple[Unnest, ...] = ()
    joins: tuple[Join, ...] = ()
    where: object | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    distinct: bool = False
    ctes: tuple[tuple[str, Query], ...] = ()
    ignored: tuple[str, ...] = field(default=())  # clauses that were read and have no effect

    @property
    def star(self) -> bool:
        return len(self.items) == 1 and self.items[0].text == "*"
