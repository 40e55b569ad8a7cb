"""Syntax trees of the SELECT dialect. All nodes are immutable and compare by value."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, is_dataclass, replace


class Node:
    def children(self) -> Iterator["Node"]:
        """Nodes right below this one, in order."""
        for f in fields(self):  # type: ignore[arg-type]
            yield from _nodes(getattr(self, f.name))

    def walk(self) -> Iterator["Node"]:
        """This node and all below it."""
        stack: list[Node] = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(list(n.children())))

    def count(self) -> int:
        return sum(1 for _ in self.walk())

    def map(self, f) -> "Node":
        """A copy in which f has been applied to every node below, leaves first."""
        changed = {x.name: _mapped(getattr(self, x.name), f) for x in fields(self)}  # type: ignore[arg-type]
        return f(replace(self, **changed))  # type: ignore[type-var]


def _nodes(v: object) -> Iterator[Node]:
    if isinstance(v, Node):
        yield v
    elif isinstance(v, tuple):
        for x in v:
            yield from _nodes(x)


def _mapped(v, f):
    if isinstance(v, Node) and is_dataclass(v):
        return v.map(f)
    if isinstance(v, tuple):
        return tuple(_mapped(x, f) for x in v)
    return v


class Expr(Node):
    pass


@dataclass(frozen=True)
class Literal(Expr):
    kind: str  # int bigint numeric text bool date timestamp interval null
    value: str
    unit: str = ""  # of intervals; empty for those written in one string


@dataclass(frozen=True)
class Column(Expr):
    name: str
    relation: str = ""


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # - + ~ @ |/ ||/ NOT
    e: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str  # + - * / % ^ & | # || = <> < <= > >= AND OR LIKE ILIKE
    left: Expr
    right: Expr
    negated: bool = False  # of LIKE


@dataclass(frozen=True)
class IsNull(Expr):
    e: Expr
    negated: bool = False


@dataclass(frozen=True)
class IsBool(Expr):
    e: Expr
    what: str  # TRUE FALSE UNKNOWN
    negated: bool = False


@dataclass(frozen=True)
class IsDistinct(Expr):
    left: Expr
    right: Expr
    negated: bool = False


@dataclass(frozen=True)
class InList(Expr):
    e: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class InQuery(Expr):
    e: Expr
    query: "Query"
    negated: bool = False


@dataclass(frozen=True)
class Between(Expr):
    e: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class Quantified(Expr):
    e: Expr
    op: str
    quantifier: str  # ANY ALL
    query: "Query"


@dataclass(frozen=True)
class Exists(Expr):
    query: "Query"
    negated: bool = False


@dataclass(frozen=True)
class Scalar(Expr):
    query: "Query"


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None = None


@dataclass(frozen=True)
class Cast(Expr):
    e: Expr
    type: str


@dataclass(frozen=True)
class OrderItem(Node):
    e: Expr
    asc: bool | None = None
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Func(Expr):
    """An aggregate or scalar function call."""

    name: str
    args: tuple[Expr, ...] = ()
    distinct: bool = False
    star: bool = False
    order_by: tuple[OrderItem, ...] = ()
    where: Expr | None = None  # FILTER


@dataclass(frozen=True)
class Window(Expr):
    func: Func
    partition_by: tuple[Expr, ...] = ()
    order_by: tuple[OrderItem, ...] = ()
    frame: str = ""


@dataclass(frozen=True)
class Position(Expr):
    what: Expr
    within: Expr


@dataclass(frozen=True)
class Extract(Expr):
    field: str
    e: Expr


@dataclass(frozen=True)
class Trim(Expr):
    side: str  # BOTH LEADING TRAILING
    what: Expr | None
    e: Expr


@dataclass(frozen=True)
class Substring(Expr):
    e: Expr
    start: Expr | None
    length: Expr | None


class FromItem(Node):
    pass


@dataclass(frozen=True)
class Table(FromItem):
    name: str
    alias: str = ""
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Derived(FromItem):
    query: "Query"
    alias: str
    columns: tuple[str, ...] = ()
    lateral: bool = False


@dataclass(frozen=True)
class Join(FromItem):
    kind: str  # INNER LEFT RIGHT FULL CROSS
    left: FromItem
    right: FromItem
    on: Expr | None = None
    using: tuple[str, ...] = ()


@dataclass(frozen=True)
class Star(Node):
    relation: str = ""


@dataclass(frozen=True)
class Item(Node):
    e: Expr
    alias: str = ""


@dataclass(frozen=True)
class Grouping(Node):
    """ROLLUP, CUBE or GROUPING SETS over sets of expressions; kind SINGLE is one group of all rows."""

    kind: str
    sets: tuple[tuple[Expr, ...], ...] = ()


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Node, ...]
    from_: tuple[FromItem, ...] = ()
    where: Expr | None = None
    group_by: tuple[Node, ...] = ()
    having: Expr | None = None
    distinct: bool = False


@dataclass(frozen=True)
class SetOp(Node):
    op: str  # UNION INTERSECT EXCEPT
    all: bool
    left: Node
    right: Node


@dataclass(frozen=True)
class Cte(Node):
    name: str
    query: "Query"
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query(Node):
    body: Node  # Select, SetOp or Query in parentheses
    order_by: tuple[OrderItem, ...] = ()
    limit: Expr | None = None
    offset: Expr | None = None
    ctes: tuple[Cte, ...] = ()
