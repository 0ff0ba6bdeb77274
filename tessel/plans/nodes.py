"""Statements and expressions as data."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Param:
    position: int


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str  # not, neg, is null, is not null
    operand: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class In:
    operand: Any
    items: tuple
    negated: bool = False


@dataclass(frozen=True)
class Like:
    operand: Any
    pattern: Any
    negated: bool = False


@dataclass(frozen=True)
class Between:
    operand: Any
    low: Any
    high: Any
    negated: bool = False


@dataclass(frozen=True)
class Arrow:
    operand: Any
    key: str
    as_text: bool


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False
    distinct: bool = False


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None

    @property
    def known_as(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Join:
    table: Table
    how: str
    on: Any


@dataclass(frozen=True)
class Order:
    expr: Any
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple
    table: Table | None = None
    joins: tuple = ()
    where: Any = None
    group: tuple = ()
    having: Any = None
    order: tuple = ()
    limit: Any = None
    offset: Any = None
    distinct: bool = False


@dataclass(frozen=True)
class SetOperation:
    op: str
    all: bool
    left: Any
    right: Any
    order: tuple = ()
    limit: Any = None
    offset: Any = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple | None
    rows: tuple = ()
    query: Any = None


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple
    where: Any = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Any = None


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str  # int, float, varchar, text, bool, json
    size: int | None = None
    nullable: bool = True
    primary: bool = False
    auto: bool = False
    default: Any = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple
    engine: str | None = None
    if_not_exists: bool = False


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple
    if_not_exists: bool = False


@dataclass(frozen=True)
class Drop:
    what: str  # table, index
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class AlterEngine:
    table: str
    engine: str


@dataclass(frozen=True)
class Simple:
    """A statement without further parts, or with one name."""

    what: str  # show tables, describe, truncate, begin, commit, rollback, checkpoint, vacuum, set, variable
    name: str | None = None


@dataclass
class Parsed:
    statement: Any
    params: int = field(default=0)


def children(node: Any) -> list[Any]:
    if isinstance(node, tuple):
        return list(node)
    return [getattr(node, f.name) for f in fields(node)] if is_dataclass(node) else []


def bind(node: Any, values: list[Any]) -> Any:
    """The same tree with each parameter replaced by its value."""
    if isinstance(node, Param):
        return Literal(values[node.position])
    if isinstance(node, tuple):
        return tuple(bind(x, values) for x in node)
    if is_dataclass(node):
        return replace(node, **{f.name: bind(getattr(node, f.name), values) for f in fields(node)})
    return node
