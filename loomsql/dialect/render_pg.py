"""Trees as text of the dialect, with the parentheses that precedence needs."""

from __future__ import annotations

import re

from . import ast as A
from .parser import RESERVED

#: Binding strength; a part that binds weaker than its place allows is put in parentheses.
STRENGTH = {"OR": 1, "AND": 2, "NOT": 3, "IS": 4, "CMP": 5, "RANGE": 6, "OTHER": 7, "ADD": 8, "MUL": 9, "POW": 10, "UNARY": 11, "ATOM": 12}
TYPE_TEXT = {"double": "double precision", "bool": "boolean"}
SETS = {"UNION": 1, "EXCEPT": 1, "INTERSECT": 2}


def name(n: str) -> str:
    return n if re.fullmatch(r"[a-z_][a-z0-9_]*", n) and n not in RESERVED else '"' + n.replace('"', '""') + '"'


def strength(e: A.Expr) -> int:
    if isinstance(e, A.Binary):
        op = e.op
        kind = op if op in ("OR", "AND") else "CMP" if op in ("=", "<>", "<", "<=", ">", ">=") else "RANGE" if op in ("LIKE", "ILIKE") else "POW" if op == "^" else "MUL" if op in "*/%" else "ADD" if op in "+-" else "OTHER"
        return STRENGTH[kind]
    if isinstance(e, A.Unary):
        return STRENGTH["NOT" if e.op == "NOT" else "UNARY"]
    if isinstance(e, (A.IsNull, A.IsBool, A.IsDistinct)):
        return STRENGTH["IS"]
    if isinstance(e, A.Quantified):
        return STRENGTH["CMP"]
    if isinstance(e, (A.InList, A.InQuery, A.Between)):
        return STRENGTH["RANGE"]
    return STRENGTH["ATOM"]


def at(e: A.Expr, least: int) -> str:
    return expr(e) if strength(e) >= least else f"({expr(e)})"


def expr(e: A.Expr) -> str:
    if isinstance(e, A.Literal):
        if e.kind in ("text", "date", "timestamp"):
            body = "'" + e.value.replace("'", "''") + "'"
            return body if e.kind == "text" else f"{e.kind.upper()} {body}"
        return {"null": "NULL", "interval": f"INTERVAL '{e.value}' {e.unit.upper()}"}.get(e.kind, e.value)
    if isinstance(e, A.Column):
        return f"{name(e.relation)}.{name(e.name)}" if e.relation else name(e.name)
    if isinstance(e, A.Unary):
        if e.op == "NOT":
            return f"NOT {at(e.e, STRENGTH['NOT'])}" if not isinstance(e.e, A.Exists) else f"NOT ({expr(e.e)})"
        return f"{e.op} {at(e.e, STRENGTH['UNARY'])}"
    if isinstance(e, A.Binary):
        s = strength(e)
        return f"{at(e.left, s)} {'NOT ' if e.negated else ''}{e.op} {at(e.right, s + 1)}"
    if isinstance(e, A.IsNull):
        return f"{at(e.e, 4)} IS {'NOT ' if e.negated else ''}NULL"
    if isinstance(e, A.IsBool):
        return f"{at(e.e, 4)} IS {'NOT ' if e.negated else ''}{e.what}"
    if isinstance(e, A.IsDistinct):
        return f"{at(e.left, 4)} IS {'NOT ' if e.negated else ''}DISTINCT FROM {at(e.right, 5)}"
    if isinstance(e, A.InList):
        return f"{at(e.e, 6)} {'NOT ' if e.negated else ''}IN ({', '.join(map(expr, e.items))})"
    if isinstance(e, A.InQuery):
        return f"{at(e.e, 6)} {'NOT ' if e.negated else ''}IN ({query(e.query)})"
    if isinstance(e, A.Between):
        return f"{at(e.e, 6)} {'NOT ' if e.negated else ''}BETWEEN {at(e.low, 7)} AND {at(e.high, 7)}"
    if isinstance(e, A.Quantified):
        return f"{at(e.e, 5)} {e.op} {e.quantifier} ({query(e.query)})"
    if isinstance(e, A.Exists):
        return f"{'NOT ' if e.negated else ''}EXISTS ({query(e.query)})"
    if isinstance(e, A.Scalar):
        return f"({query(e.query)})"
    if isinstance(e, A.Case):
        whens = "".join(f" WHEN {expr(c)} THEN {expr(r)}" for c, r in e.whens)
        return f"CASE{' ' + expr(e.operand) if e.operand else ''}{whens}{' ELSE ' + expr(e.otherwise) if e.otherwise else ''} END"
    if isinstance(e, A.Cast):
        return f"CAST({expr(e.e)} AS {TYPE_TEXT.get(e.type, e.type)})"
    if isinstance(e, A.Func):
        inner = "*" if e.star else ("DISTINCT " if e.distinct else "") + ", ".join(map(expr, e.args))
        by = " ORDER BY " + order(e.order_by) if e.order_by else ""
        return f"{e.name}({inner}{by})" + (f" FILTER (WHERE {expr(e.where)})" if e.where else "")
    if isinstance(e, A.Window):
        parts = ["PARTITION BY " + ", ".join(map(expr, e.partition_by))] if e.partition_by else []
        parts += ["ORDER BY " + order(e.order_by)] if e.order_by else []
        return f"{expr(e.func)} OVER ({' '.join(parts + [e.frame] * bool(e.frame))})"
    if isinstance(e, A.Position):
        return f"POSITION({at(e.what, 7)} IN {at(e.within, 7)})"
    if isinstance(e, A.Extract):
        return f"EXTRACT({e.field} FROM {expr(e.e)})"
    if isinstance(e, A.Trim):
        return f"TRIM({e.side} {expr(e.what) + ' ' if e.what else ''}FROM {expr(e.e)})"
    if isinstance(e, A.Substring):
        return f"SUBSTRING({expr(e.e)}{' FROM ' + expr(e.start) if e.start else ''}{' FOR ' + expr(e.length) if e.length else ''})"
    raise TypeError(type(e).__name__)


def order(items: tuple[A.OrderItem, ...]) -> str:
    return ", ".join(expr(o.e) + {True: " ASC", False: " DESC", None: ""}[o.asc] + {True: " NULLS FIRST", False: " NULLS LAST", None: ""}[o.nulls_first] for o in items)


def columns(names: tuple[str, ...]) -> str:
    return f" ({', '.join(map(name, names))})" if names else ""


def from_item(f: A.FromItem) -> str:
    if isinstance(f, A.Table):
        return name(f.name) + (f" AS {name(f.alias)}{columns(f.columns)}" if f.alias else "")
    if isinstance(f, A.Derived):
        return f"{'LATERAL ' if f.lateral else ''}({query(f.query)}) AS {name(f.alias)}{columns(f.columns)}"
    assert isinstance(f, A.Join)
    right = from_item(f.right)
    if isinstance(f.right, A.Join):
        right = f"({right})"
    tail = f" ON {expr(f.on)}" if f.on else f" USING ({', '.join(map(name, f.using))})" if f.using else ""
    return f"{from_item(f.left)} {f.kind} JOIN {right}{tail}"


def grouping(g: A.Node) -> str:
    if isinstance(g, A.Grouping):
        if g.kind == "SINGLE":
            return "()"
        return f"{g.kind} (" + ", ".join(expr(s[0]) if len(s) == 1 else "(" + ", ".join(map(expr, s)) + ")" for s in g.sets) + ")"
    return expr(g)  # type: ignore[arg-type]


def body(n: A.Node, least: int = 0) -> str:
    if isinstance(n, A.Query):
        return f"({query(n)})"
    if isinstance(n, A.SetOp):
        s = SETS[n.op]
        text = f"{body(n.left, s)} {n.op}{' ALL' if n.all else ''} {body(n.right, s + 1)}"
        return text if s >= least else f"({text})"
    assert isinstance(n, A.Select)
    items = [("*" if not i.relation else f"{name(i.relation)}.*") if isinstance(i, A.Star) else expr(i.e) + (f" AS {name(i.alias)}" if i.alias else "") for i in n.items]  # type: ignore[union-attr]
    text = f"SELECT {'DISTINCT ' if n.distinct else ''}{', '.join(items)}"
    if n.from_:
        text += " FROM " + ", ".join(map(from_item, n.from_))
    if n.where:
        text += f" WHERE {expr(n.where)}"
    if n.group_by:
        text += " GROUP BY " + ", ".join(map(grouping, n.group_by))
    if n.having:
        text += f" HAVING {expr(n.having)}"
    return text


def query(q: A.Query) -> str:
    text = ""
    if q.ctes:
        text = "WITH " + ", ".join(f"{name(c.name)}{columns(c.columns)} AS ({query(c.query)})" for c in q.ctes) + " "
    text += body(q.body)
    if q.order_by:
        text += f" ORDER BY {order(q.order_by)}"
    if q.limit:
        text += f" LIMIT {expr(q.limit)}"
    if q.offset:
        text += f" OFFSET {expr(q.offset)}"
    return text
