"""One walk over the grammar for three uses: random generation, recognition of a given tree, and replay of a path.

The walk makes decisions (an option of a grammar function) and takes values (names and literals). In generation a chooser
makes them, in recognition the tree does, in replay the path does. All three write the path, so recognising a tree and
replaying the path gives the tree back.

Every query the walk can make is valid for its schema: columns are always in scope and of the wanted type, grouped
queries use grouped columns and aggregates only, scalar subqueries yield one row.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

from . import ast as A
from .binder import Binder, Relation
from .grammar import AGGREGATES, COMPARISONS, DATE_FIELDS, GRAMMAR, LEAST_CALLS, NARROWER, NUMBERS, SPAN_FIELDS, TIME_FIELDS, TYPES

Step = tuple  # ("call", f, detail), ("option", f, o), ("value", what, v) or ("exit", f)


class NotRecognised(ValueError):
    pass


class Chooser:
    """Makes the decisions of a generated query. ``stack`` holds the functions being walked, outermost first."""

    def option(self, stack: list[str], before: str, options: list[str]) -> str:
        raise NotImplementedError

    def value(self, what: str, options: list):
        raise NotImplementedError

    def number(self, low: int, high: int) -> int:
        raise NotImplementedError


#: Options that would crowd out others weigh less than 1.
RARE = {"typed null": 0.1, "literal": 0.5}


class RandomChooser(Chooser):
    """Uniform or weighted by a model; beyond ``stir`` calls the weights fall by e^-100 for each call an option still needs."""

    def __init__(self, seed: int, stir: int = 6, weights: Callable[[list[str], str, list[str]], list[float]] | None = None, greedy: bool = False):
        self.random = random.Random(seed)
        self.stir = stir
        self.weights = weights
        self.greedy = greedy

    def option(self, stack: list[str], before: str, options: list[str]) -> str:
        if len(options) == 1:
            return options[0]
        if len(stack) > self.stir:
            least = LEAST_CALLS[stack[-1]]
            fewest = min(least[o] for o in options)
            options = [o for o in options if least[o] == fewest]
            if len(options) == 1:
                return options[0]
        w = self.weights(stack, before, options) if self.weights else [RARE.get(o, 1.0) for o in options]
        if self.greedy:
            return options[max(range(len(options)), key=lambda k: w[k])]
        return self.random.choices(options, w)[0]

    def value(self, what: str, options: list):
        return options[int(self.random.random() * len(options))]

    def number(self, low: int, high: int) -> int:
        return self.random.randint(low, high)


class PathChooser(Chooser):
    """Takes decisions and values from a path."""

    def __init__(self, path: list[Step]):
        self.steps = iter([s for s in path if s[0] in ("option", "value")])

    def _next(self, kind: str):
        s = next(self.steps, None)
        if s is None or s[0] != kind:
            raise NotRecognised(f"the path has {s}, the walk wants a {kind}")
        return s[-1]

    def option(self, stack: list[str], before: str, options: list[str]) -> str:
        o = self._next("option")
        if o not in options:
            raise NotRecognised(f"{o} isn't open in {stack[-1]}")
        return o

    def value(self, what: str, options: list):
        return self._next("value")

    def number(self, low: int, high: int) -> int:
        return self._next("value")


@dataclass
class Context:
    """What an expression may use."""

    relations: list[Relation]
    grouped: list[tuple[A.Column, str]] | None = None  # of a grouped query
    aggregates: bool = False
    columns: bool = True
    depth: int = 0  # of subqueries
    pools: dict[str, list[A.Column]] = field(default_factory=dict)

    def pool(self, t: str) -> list[A.Column]:
        got = self.pools.get(t)
        if got is None:
            fits = (t, *NARROWER.get(t, ()))
            if not self.columns:
                got = []
            elif self.grouped is not None:
                got = [c for c, k in self.grouped if k in fits]
            else:
                got = [A.Column(n, r.alias) for r in self.relations for n, k in r.columns if n and kind(k) in fits]
            self.pools[t] = got
        return got

    def around(self) -> list[Relation]:
        """What a subquery here may refer to: nothing of a grouped query, whose rows are no longer there."""
        return self.relations if self.grouped is None and self.columns else []

    def inner(self) -> "Context":
        """For arguments of aggregates."""
        return Context(self.relations, None, False, self.columns, self.depth)


def kind(t: str) -> str:
    t = t.partition("(")[0]
    return {"double": "numeric", "other": "", "null": "int"}.get(t, t)


MAX_DEPTH = 4
LITERALS = {
    "text": ("text", "loom", ""), "date": ("date", "2001-02-03", ""), "timestamp": ("timestamp", "2001-02-03 04:05:06", ""), "interval": ("interval", "1", "day"),
}


class Call(str):
    """The name of a function being walked, with its parameters and open gates."""

    __slots__ = ("detail",)

    def __new__(cls, name: str, detail: str = "") -> "Call":
        self = super().__new__(cls, name)
        self.detail = detail
        return self


class Walker:
    def __init__(self, schema: dict[str, Relation], chooser: Chooser | None = None, types: Callable[[A.Expr], str] | None = None):
        self.schema = schema
        self.tables = sorted(schema)
        self.chooser = chooser
        self.type_of = types
        self.path: list[Step] = []
        self.stack: list[str] = []
        self.before: list[str] = []
        self.aliases = 0
        self.no_literal = False
        self.no_bare = 0

    # decisions

    def enter(self, f: str, detail: str = "") -> None:
        self.stack.append(Call(f, detail))
        self.before.append("entry")
        self.path.append(("call", f, detail))

    def leave(self) -> None:
        self.path.append(("exit", str(self.stack.pop())))
        self.before.pop()

    def option(self, options: list[str], want: str | None) -> str:
        f = self.stack[-1]
        if self.chooser is None:
            if want not in options:
                raise NotRecognised(f"{want} isn't open in {f}")
            o = want
        else:
            o = self.chooser.option(self.stack, self.before[-1], options)
        self.before[-1] = o
        self.path.append(("option", f, o))
        return o

    def value(self, what: str, options: list, want):
        v = want if self.chooser is None else self.chooser.value(what, options)
        if self.chooser is None and options and v not in options:
            raise NotRecognised(f"{what} {v}")
        self.path.append(("value", what, v))
        return v

    def number(self, what: str, low: int, high: int, want: int) -> int:
        v = want if self.chooser is None else self.chooser.number(low, high)
        self.path.append(("value", what, v))
        return v

    @property
    def given(self) -> bool:
        return self.chooser is None

    def alias(self, want: str) -> str:
        self.aliases += 1
        return self.value("alias", [], want) if self.given else self.value("alias", [f"t{self.aliases}"], None)

    # queries

    def query(self, depth: int = 0, types: list[str] | None = None, single: bool = False, t: A.Query | None = None, outer: list[Relation] | None = None, sorted_around: bool = False) -> tuple[A.Query, list[tuple[str, str]]]:
        if t is not None and (t.ctes or t.offset):
            raise NotRecognised("WITH and OFFSET aren't in the grammar")
        self.enter("query", ("single " if single else "") + ",".join(types or ()))
        # In a chain of queries right around each other one has an ORDER BY, and one a LIMIT.
        o = self.option(["plain"] if sorted_around else ["plain", "ordered"], t and ("ordered" if t.order_by else "plain"))
        body, columns, ctx, select = self.body(depth, types, single, t.body if t else None, outer, sorted_around or o == "ordered")
        order: list[A.OrderItem] = []
        if o == "ordered":
            n = self.number("order items", 1, 2, len(t.order_by) if t else 0)
            order = [self.order(columns, ctx, select, t.order_by[i] if t else None) for i in range(n)]
        limit = None
        one_row = isinstance(body, A.Select) and (Binder({}).has_aggregate(body.items) if not body.group_by else any(isinstance(g, A.Grouping) and g.kind == "SINGLE" for g in body.group_by))
        self.enter("limit")
        limited, inside = False, body
        while isinstance(inside, A.Query):
            limited, inside = limited or inside.limit is not None, inside.body
        options = ["none"] if limited else (["none"] if not single or one_row else []) + ["one"] + ([] if single else ["n"])
        want = t and ("none" if t.limit is None else "one" if t.limit == A.Literal("int", "1") else "n")
        if self.option(options, want) != "none":
            limit = A.Literal("int", "1") if self.before[-1] == "one" else self.value("limit", [A.Literal("int", str(k)) for k in (2, 5, 10)] if not self.given else [], t.limit if t else None)
        self.leave()
        self.leave()
        if isinstance(body, A.Query) and not order and limit is None:
            return body, columns
        return A.Query(body, tuple(order), limit), columns

    def order(self, columns, ctx, select, t: A.OrderItem | None) -> A.OrderItem:
        self.enter("order")
        names = [n for n, _ in columns]
        unique = [n for n in names if n and names.count(n) == 1]
        expression = ctx is not None and not select.distinct
        by_output = t is not None and isinstance(t.e, A.Column) and not t.e.relation
        o = self.option((["output"] if unique else []) + (["expression"] if expression or not unique else []), t and ("output" if by_output else "expression"))
        if o == "output":
            e: A.Expr = A.Column(self.value("output", unique, t.e.name if t else None))
        elif not expression:
            raise NotRecognised("nothing to sort by")
        else:
            self.no_literal = True  # a number would be a position
            self.no_bare += 1  # a bare name would be an output
            e = self.expr(self.type("sort type", ctx, t and t.e), ctx, t.e if t else None)
            self.no_bare -= 1
        asc = self.value("direction", [None, True, False], t.asc if t else None)
        nulls = self.value("nulls", [None, True, False], t.nulls_first if t else None)
        self.leave()
        return A.OrderItem(e, asc, nulls)

    def body(self, depth, types, single, t, outer=None, sorted_around=False):
        self.enter("body", ",".join(types or ()))
        options = ["select"] if single else ["select", "union", "intersect", "except"] + ["query"] * (depth < MAX_DEPTH)
        if depth >= MAX_DEPTH:
            options = ["select"]
        want = None
        if t is not None:
            want = "select" if isinstance(t, A.Select) else "query" if isinstance(t, A.Query) else t.op.lower()
            if isinstance(t, A.SetOp) and t.all:
                raise NotRecognised("ALL isn't in the grammar")
        o = self.option(options, want)
        if o == "select":
            out = self.select(depth, types, t, outer)
        elif o == "query":
            q, columns = self.query(depth + 1, types, False, t, None, sorted_around)
            plain = q.order_by or q.limit
            out = (q if plain else q.body, columns, None, None)  # parentheses alone leave no trace
        else:
            if types is None:
                n = self.number("columns", 1, 3, self.width(t) if t else 0)
                types = [self.value("column type", list(TYPES), self.column_type(t, i) if t else None) for i in range(n)]
            left, columns, *_ = self.body(depth + 1, types, False, t.left if t else None)
            right, *_ = self.body(depth + 1, types, False, t.right if t else None)
            out = (A.SetOp(o.upper(), False, left, right), columns, None, None)
        self.leave()
        return out

    def selects(self, t: A.Node) -> list[A.Select]:
        out, stack = [], [t]
        while stack:
            x = stack.pop()
            if isinstance(x, A.Select):
                out.append(x)
            else:
                stack += [x.right, x.left] if isinstance(x, A.SetOp) else [x.body]
        return out

    def width(self, t: A.Node) -> int:
        return len(self.selects(t)[0].items)

    def column_type(self, t: A.Node, i: int) -> str:
        best = ""
        for s in self.selects(t):
            k = kind(self.type_of(s.items[i].e))
            best = k if not best or k in NUMBERS and NUMBERS.index(k) > NUMBERS.index(best) else best
        return best

    def select(self, depth, types, t, outer=None):
        self.enter("select")
        distinct = self.option(["all", "distinct"], t and ("distinct" if t.distinct else "all")) == "distinct"
        relations: list[Relation] = []
        from_ = self.from_(relations, depth, t.from_ if t else None)
        # WHERE also sees the columns of the query right around this one.
        where = self.clause("where", Context(relations + (outer or []), depth=depth), t and (t.where or False))
        group, grouped = self.group(relations, t)
        having = None
        if group:
            ctx = Context(relations, grouped, True, depth=depth)
            having = self.clause("having", ctx, t and (t.having or False))
        else:
            if t and t.having:
                raise NotRecognised("HAVING needs GROUP BY")
            alone = t and Binder({}).has_aggregate(t.items)
            ctx = Context(relations, [], True, depth=depth) if self.value("aggregated", [False, False, False, True], bool(alone)) else Context(relations, depth=depth)
        items, columns = self.items(types, ctx, t)
        self.leave()
        s = A.Select(tuple(items), tuple(from_), where, group, having, distinct)
        return s, columns, ctx, s

    def clause(self, f: str, ctx: Context, t) -> A.Expr | None:
        self.enter(f)
        o = self.option(["none", f], None if t is None else f if t else "none")
        e = self.expr("bool", ctx, t or None) if o != "none" else None
        self.leave()
        return e

    def from_(self, relations: list[Relation], depth: int, t) -> list[A.FromItem]:
        self.enter("from")
        o = self.option(["one", "more"], t and ("more" if len(t) > 1 else "one"))
        if t is not None and not t:
            raise NotRecognised("FROM is needed")
        chain: list[Relation] = []
        out = [self.from_item(chain, depth, t[0] if t else None)]
        relations += chain
        if o == "more":
            out += self.from_(relations, depth, t[1:] if t else None)
        self.leave()
        return out

    def from_item(self, chain: list[Relation], depth: int, t) -> A.FromItem:
        self.enter("from_item")
        options = ["table"] + (["derived"] if depth < MAX_DEPTH else []) + ["join"]
        want = t and ("table" if isinstance(t, A.Table) else "join" if isinstance(t, A.Join) else "derived")
        o = self.option(options, want)
        if o == "table":
            name = self.value("table", self.tables, t.name if t else None)
            alias = self.alias(t.alias if t else "")
            columns = self.schema[name].columns
            names: tuple[str, ...] = ()
            if self.value("renamed", [False, False, True], bool(t.columns) if t else None):
                names = self.value("names", [tuple(f"c{k}" for k in range(len(columns)))], t.columns if t else None) if not self.given else self.value("names", [], t.columns)
            chain.append(Relation(alias, tuple((names[i] if i < len(names) else n, k) for i, (n, k) in enumerate(columns))))
            out: A.FromItem = A.Table(name, alias, names)
        elif o == "derived":
            if t is not None and t.lateral:
                raise NotRecognised("LATERAL isn't in the grammar")
            q, columns = self.query(depth + 1, None, False, t.query if t else None)
            alias = self.alias(t.alias if t else "")
            names = tuple(f"c{k}" for k in range(len(columns))) if not self.given else t.columns
            names = self.value("names", [names], names)
            chain.append(Relation(alias, tuple((n, k) for n, (_, k) in zip(names, columns))))
            out = A.Derived(q, alias, names)
        else:
            own: list[Relation] = []  # what ON sees
            left = self.from_item(own, depth, t.left if t else None)
            right = self.from_item(own, depth, t.right if t else None)
            how = self.value("join", ["INNER", "LEFT", "RIGHT", "FULL"], t.kind if t else None)
            out = A.Join(how, left, right, self.expr("bool", Context(own, depth=MAX_DEPTH), t.on if t else None))
            chain += own
        self.leave()
        return out

    def group(self, relations, t):
        self.enter("group")
        pool = [(A.Column(n, r.alias), kind(k)) for r in relations for n, k in r.columns if n and kind(k)]
        want = None
        gs = t.group_by if t is not None else ()
        if t is not None:
            special = [g for g in gs if isinstance(g, A.Grouping)]
            if not all(isinstance(g, (A.Grouping, A.Column)) for g in gs):
                raise NotRecognised("GROUP BY takes columns and special groupings")
            want = "none" if not gs else "columns" if not special else "mixed" if len(gs) > 1 else special[0].kind.lower()
        options = ["none", "single"] + (["columns", "rollup", "cube", "grouping sets", "mixed"] if pool else [])
        o = self.option(options, want)
        group: tuple[A.Node, ...] = ()
        keys = [c for c, _ in pool]

        def key(want) -> A.Column:
            return self.value("key", keys, want)

        def special_part(kind_: str, g) -> A.Grouping:
            sets = g.sets if g is not None else ()
            low = 0 if kind_ == "grouping sets" else 1
            new = []
            for i in range(self.number("sets", 1, 3, len(sets))):
                m = self.number("set size", low, 2, len(sets[i]) if g is not None else 0)
                new.append(tuple(key(sets[i][j] if g is not None else None) for j in range(m)))
            return A.Grouping(kind_.upper(), tuple(new))

        if o == "single":
            group = (A.Grouping("SINGLE"),)
        elif o == "columns":
            cols = [key(gs[i] if gs else None) for i in range(self.number("keys", 1, 3, len(gs)))]
            group = tuple(dict.fromkeys(cols)) if t is None else tuple(cols)
        elif o == "mixed":
            parts: list[A.Node] = []
            for i in range(self.number("parts", 2, 3, len(gs))):
                g = gs[i] if gs else None
                of = self.value("part", ["rollup", "cube", "grouping sets"] + ["column"] * (i > 0 or self.given), g and ("column" if isinstance(g, A.Column) else g.kind.lower()))
                parts.append(key(g) if of == "column" else special_part(of, g))
            group = tuple(parts)
        elif o != "none":
            group = (special_part(o, gs[0] if gs else None),)
        kinds = dict(pool)
        used = [c for g in group for c in ([g] if isinstance(g, A.Column) else [c for one in g.sets for c in one])]  # type: ignore[union-attr]
        grouped = [(c, kinds[c]) for c in dict.fromkeys(used)]
        self.leave()
        return group, grouped

    def items(self, types, ctx: Context, t):
        self.enter("items", ",".join(types or ()))
        out: list[A.Node] = []
        columns: list[tuple[str, str]] = []
        plain = [r for r in ctx.relations if r.columns and all(n and kind(k) for n, k in r.columns)]
        stars = types is None and ctx.grouped is None and not self.given and len(plain) == len(ctx.relations)
        names = [n for r in ctx.relations for n, _ in r.columns]
        once = stars and len(set(names)) == len(names)  # outputs are sorted by their names
        o = self.option(["list"] + ["star"] * once + ["relation star"] * stars, "list")  # bound trees have their stars spelt out
        if o != "list":
            of = self.value("relation", plain, None) if o == "relation star" else None
            columns = [(n, kind(k)) for r in ([of] if of else ctx.relations) for n, k in r.columns]
            self.leave()
            return [A.Star(of.alias if of else "")], columns
        n = len(types) if types is not None else self.number("items", 1, 4, len(t.items) if t else 0)
        if t is not None and len(t.items) != n:
            raise NotRecognised(f"{len(t.items)} columns, not {n}")
        for i in range(n):
            it = t.items[i] if t else None
            k = types[i] if types is not None else self.type("item type", ctx, it and it.e)
            e = self.expr(k, ctx, it.e if it else None)
            name = self.value("name", [f"x{i}"], it.alias if it else None) if not self.given else self.value("name", [], it.alias)
            out.append(A.Item(e, name))
            columns.append((name, k))
        self.leave()
        return out, columns

    # expressions

    def type(self, what: str, ctx: Context, t: A.Expr | None) -> str:
        return self.value(what, list(TYPES), kind(self.type_of(t)) if t is not None else None)

    def expr(self, k: str, ctx: Context, t: A.Expr | None = None) -> A.Expr:
        f = f"expr_{k}"
        self.enter(f, "aggregates " * ctx.aggregates + "grouped " * (ctx.grouped is not None) + "no literal " * self.no_literal + "deep" * (ctx.depth >= MAX_DEPTH))
        deep = ctx.depth >= MAX_DEPTH
        options = []
        for o in GRAMMAR[f]:
            if o == "column" and not ctx.pool(k) or o == "aggregate" and not ctx.aggregates:
                continue
            if deep and o in ("scalar", "exists", "in query", "any", "all") or self.no_literal and o == "literal":
                continue
            options.append(o)
        want = None
        if t is not None:
            want = self.label(t, k)
            if want not in options or want == "aggregate" and (t.name not in AGGREGATES[k] or t.star and k != "bigint"):
                narrow = f"narrow {kind(self.type_of(t))}"
                want = narrow if narrow in options else want
        o = self.option(options, want)
        self.no_literal &= o.startswith("narrow ")
        e = self.make(o, k, ctx, t)
        self.leave()
        return e

    def label(self, t: A.Expr, k: str) -> str:
        if isinstance(t, A.Literal):
            return "literal"
        if isinstance(t, A.Column):
            return "column"
        if isinstance(t, A.Cast):
            return "typed null" if isinstance(t.e, A.Literal) and t.e.kind == "null" else "cast"
        if isinstance(t, A.Case):
            return "simple case" if t.operand else "case"
        if isinstance(t, A.Scalar):
            return "scalar"
        if isinstance(t, A.Func):
            return "aggregate"
        if isinstance(t, A.Unary):
            return "not" if t.op == "NOT" else f"unary {t.op}"
        if isinstance(t, A.Binary):
            if t.op in ("AND", "OR", "LIKE"):
                return t.op.lower()
            if t.op == "||":
                return "concat"
            if t.op in COMPARISONS:
                return "compare"
            a, b = kind(self.type_of(t.left)), kind(self.type_of(t.right))
            if k == "date":
                return "int + date" if b == "date" else f"date {t.op} int"
            if k == "timestamp":
                return "date + interval" if a == "date" and t.op == "+" else f"{t.op} interval"
            if k == "interval" and a == "timestamp":
                return "ts - ts"
            return f"op {t.op}"
        if isinstance(t, A.Quantified):
            return t.quantifier.lower()
        if isinstance(t, A.Extract):
            return f"extract {kind(self.type_of(t.e))}"
        if isinstance(t, A.Trim):
            return "trim what" if t.what else "trim"
        names = {"IsNull": "is null", "IsDistinct": "distinct", "InList": "in list", "InQuery": "in query", "Between": "between", "Exists": "exists", "Position": "position", "Substring": "substring"}
        return names.get(type(t).__name__, type(t).__name__)

    def operand_type(self, ctx: Context, *ts: A.Expr | None) -> str:
        """A type for operands that only have to fit each other; that of the widest if they are given."""
        best = None
        if self.given:
            for t in ts:
                k = kind(self.type_of(t))
                best = k if best is None or k in NUMBERS and best in NUMBERS and NUMBERS.index(k) > NUMBERS.index(best) else best
        return self.value("operand type", [k for k in TYPES if k != "interval"] if not self.given else [], best)

    def literal(self, k: str, t):
        if self.given:
            return self.value("literal", [], t)
        if k in LITERALS:
            options = [A.Literal(*LITERALS[k])]
        elif k == "bool":
            options = [A.Literal("bool", "true"), A.Literal("bool", "false")]
        elif k == "numeric":
            options = [A.Literal("numeric", f"{i / 4:.2f}") for i in range(20)]
        else:
            options = [A.Literal("int", str(i)) for i in range(6)]
        return self.value("literal", options, None)

    def aggregate(self, k: str, ctx: Context, t) -> A.Expr:
        self.enter("aggregate")
        o = self.option(["call", "distinct"] + ["star"] * (k == "bigint"), t and ("star" if t.star else "distinct" if t.distinct else "call"))
        if t is not None and (t.where or t.order_by or t.name not in AGGREGATES[k]):
            raise NotRecognised(f"{t.name} with FILTER or ORDER BY, or of another type")
        if o == "star":
            e = A.Func("count", star=True)
        else:
            name = self.value("function", list(AGGREGATES[k]), t.name if t else None)
            args = []
            for i, a in enumerate(AGGREGATES[k][name]):
                ta = t.args[i] if t else None
                inner = ctx.inner()
                if name == "string_agg" and i == 1 and not self.given:
                    args.append(self.value("literal", [A.Literal("text", ",")], None))
                    continue
                if name == "string_agg" and i == 1:
                    args.append(self.value("literal", [], ta))
                    continue
                args.append(self.expr(self.type("argument type", inner, ta) if a == "any" else a, inner, ta))
            e = A.Func(name, tuple(args), o == "distinct")
        self.leave()
        return e

    def make(self, o: str, k: str, ctx: Context, t) -> A.Expr:
        x = lambda kk, tt=None: self.expr(kk, ctx, tt)
        g = t is not None
        if o == "literal":
            return self.literal(k, t)
        if o == "column":
            c = self.value("column", ctx.pool(k), t)
            bare = not self.given and not self.no_bare and sum(n == c.name for r in ctx.relations for n, _ in r.columns) == 1
            return A.Column(c.name) if not self.value("qualified", [True, True, False] if bare else [True], True if self.given else None) else c
        if o == "typed null":
            return A.Cast(A.Literal("null", ""), self.value("null type", [{"numeric": "numeric"}.get(k, k)], t.type if g else None) if not self.given else self.value("null type", [], t.type))
        if o.startswith("narrow "):
            return x(o[7:], t)
        if o in ("case", "simple case"):
            n = self.number("branches", 1, 2, len(t.whens) if g else 0)
            kk = self.operand_type(ctx, t.operand, *(c for c, _ in t.whens)) if o == "simple case" and g else self.operand_type(ctx) if o == "simple case" else "bool"
            operand = x(kk, t.operand if g else None) if o == "simple case" else None
            whens = tuple((x(kk, t.whens[i][0] if g else None), x(k, t.whens[i][1] if g else None)) for i in range(n))
            other = x(k, t.otherwise if g else None) if self.value("else", [True, False], t.otherwise is not None if g else None) else None
            return A.Case(operand, whens, other)
        if o == "scalar":
            return A.Scalar(self.query(ctx.depth + 1, [k], True, t.query if g else None, ctx.around())[0])
        if o == "aggregate":
            return self.aggregate(k, ctx, t)
        if o.startswith("unary "):
            return A.Unary(o[6:], x(k, t.e if g else None))
        if o.startswith("op "):
            return A.Binary(o[3:], x(k, t.left if g else None), x(k, t.right if g else None))
        if o == "not":
            return A.Unary("NOT", x("bool", t.e if g else None))
        if o in ("and", "or"):
            return A.Binary(o.upper(), x("bool", t.left if g else None), x("bool", t.right if g else None))
        if o == "concat":
            return A.Binary("||", x("text", t.left if g else None), x("text", t.right if g else None))
        if o == "like":
            left, right = x("text", t.left if g else None), x("text", t.right if g else None)
            return A.Binary("LIKE", left, right, self.value("negated", [False, True], t.negated if g else None))
        if o in ("date + int", "date - int"):
            return A.Binary(o[5], x("date", t.left if g else None), x("int", t.right if g else None))
        if o == "int + date":
            return A.Binary("+", x("int", t.left if g else None), x("date", t.right if g else None))
        if o in ("+ interval", "- interval"):
            return A.Binary(o[0], x("timestamp", t.left if g else None), x("interval", t.right if g else None))
        if o == "date + interval":
            return A.Binary("+", x("date", t.left if g else None), x("interval", t.right if g else None))
        if o == "ts - ts":
            return A.Binary("-", x("timestamp", t.left if g else None), x("timestamp", t.right if g else None))
        if o == "position":
            return A.Position(x("text", t.what if g else None), x("text", t.within if g else None))
        if o.startswith("extract "):
            kk = o[8:]
            f = self.value("field", list(TIME_FIELDS if kk == "timestamp" else SPAN_FIELDS if kk == "interval" else DATE_FIELDS), t.field if g else None)
            return A.Extract(f, x(kk, t.e if g else None))
        if o in ("trim", "trim what"):
            side = self.value("side", ["BOTH", "LEADING", "TRAILING"], t.side if g else None)
            what = x("text", t.what if g else None) if o == "trim what" else None
            return A.Trim(side, what, x("text", t.e if g else None))
        if o == "substring":
            e = x("text", t.e if g else None)
            start = x("int", t.start if g else None) if self.value("from", [True, False], t.start is not None if g else None) else None
            length = x("int", t.length if g else None) if self.value("for", [True, False] if start else [True], t.length is not None if g else None) else None
            return A.Substring(e, start, length)
        if o == "is null":
            e = x(self.type("null test type", ctx, t.e if g else None), t.e if g else None)
            return A.IsNull(e, self.value("negated", [False, True], t.negated if g else None))
        if o == "exists":
            q = self.query(ctx.depth + 1, None, False, t.query if g else None, ctx.around())[0]
            return A.Exists(q, self.value("negated", [False, True], t.negated if g else None))
        # the operands below share one type
        left = {"compare": "left", "distinct": "left"}.get(o, "e")
        tl = getattr(t, left) if g else None
        if o in ("compare", "distinct"):
            kk = self.operand_type(ctx, tl, t.right) if g else self.operand_type(ctx)
            a, b = x(kk, tl), x(kk, t.right if g else None)
            if o == "distinct":
                return A.IsDistinct(a, b, self.value("negated", [False, True], t.negated if g else None))
            return A.Binary(self.value("comparison", list(COMPARISONS), t.op if g else None), a, b)
        if o == "between":
            kk = self.operand_type(ctx, t.e, t.low, t.high) if g else self.operand_type(ctx)
            e = A.Between(x(kk, tl), x(kk, t.low if g else None), x(kk, t.high if g else None), False)
            if g and t.negated:
                raise NotRecognised("NOT BETWEEN isn't in the grammar")
            return e
        if o == "in list":
            kk = self.operand_type(ctx, t.e, *t.items) if g else self.operand_type(ctx)
            n = self.number("list", 1, 3, len(t.items) if g else 0)
            e = x(kk, tl)
            items = tuple(x(kk, t.items[i] if g else None) for i in range(n))
            return A.InList(e, items, self.value("negated", [False, True], t.negated if g else None))
        inner = self.column_type(t.query.body, 0) if g else None
        if g:
            k0 = kind(self.type_of(t.e))
            inner = k0 if k0 in NUMBERS and inner in NUMBERS and NUMBERS.index(k0) > NUMBERS.index(inner) else inner
        kk = self.value("operand type", [k for k in TYPES if k != "interval"] if not self.given else [], inner)
        e = x(kk, tl)
        q = self.query(ctx.depth + 1, [kk], False, t.query if g else None, ctx.around())[0]
        if o == "in query":
            return A.InQuery(e, q, self.value("negated", [False, True], t.negated if g else None))
        op = self.value("comparison", list(COMPARISONS), t.op if g else None)
        return A.Quantified(e, op, o.upper(), q)


def generate(schema: dict[str, Relation], seed: int, stir: int = 6, weights=None) -> tuple[A.Query, list[Step]]:
    """A random query that is valid for the schema, and its path."""
    w = Walker(schema, RandomChooser(seed, stir, weights))
    return w.query()[0], w.path


def recognise(schema: dict[str, Relation], q: A.Query) -> tuple[A.Query, list[Step]]:
    """(the query with names spelt out, its path); NotRecognised if the grammar can't make it."""
    binder = Binder(schema)
    bound = binder.query(q).query
    w = Walker(schema, None, binder.type)
    w.query(t=bound)
    return bound, w.path


def replay(schema: dict[str, Relation], path: list[Step]) -> A.Query:
    return Walker(schema, PathChooser(path)).query()[0]


