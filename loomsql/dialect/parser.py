"""Reads PostgreSQL-flavoured SELECT text: a tokenizer and a recursive-descent parser by operator precedence."""

from __future__ import annotations

import re

from . import ast as A


class SyntaxProblem(ValueError):
    pass


TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<number>\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)
    |(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<word>[^\W\d]\w*)
    |(?P<op>\|\|/|\|/|\|\||::|<=|>=|<>|!=|[-+*/%^&|\#~@=<>(),.;\[\]])""",
    re.X | re.S,
)
#: Words that can't be an alias without AS.
RESERVED = frozenset(
    "all and any as asc between both by case cast cross desc distinct else end except exists extract false fetch for from full group grouping having in "
    "inner intersect into is join leading left like ilike limit not null offset on or order outer over partition right select set some "
    "then trailing true union using when where window with".split()
)
TYPES = {
    "int": "int", "integer": "int", "int4": "int", "smallint": "int", "bigint": "bigint", "int8": "bigint", "numeric": "numeric", "decimal": "numeric", "number": "numeric",
    "real": "double", "float": "double", "double": "double", "float8": "double", "bool": "bool", "boolean": "bool", "text": "text", "varchar": "text", "char": "text",
    "character": "text", "date": "date", "timestamp": "timestamp", "datetime": "timestamp", "interval": "interval", "bytea": "bytea", "blob": "bytea",
}
UNITS = frozenset("second minute hour day week month year".split())
COMPARISONS = frozenset(("=", "<>", "!=", "<", "<=", ">", ">="))
WINDOW_ONLY = frozenset("row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value".split())


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"can't read {text[at:at + 20]!r}")
        at = m.end()
        if m.lastgroup == "word":
            out.append(("word", m[0]))
        elif m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
    return out


SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
MONTHS = {"month": 1, "year": 12}


def interval(text: str) -> A.Literal:
    """One literal for '1 day', '2 hours 30 minutes', '1 day 02:03:04' or '1 year 2 months'; days and months don't mix (R9)."""
    parts = re.findall(r"(-?\d+)\s*(second|minute|hour|day|week|month|year)s?\b", text, re.I)
    clock = re.search(r"(?<![\d:])(\d+):(\d\d)(?::(\d\d))?", text)
    left = re.sub(r"-?\d+\s*(?:second|minute|hour|day|week|month|year)s?\b|\d+:\d\d(?::\d\d)?", "", text, flags=re.I).strip()
    if left or not parts and not clock:
        raise SyntaxProblem(f"interval {text!r}")
    units = [(int(n), u.lower()) for n, u in parts]
    if len(units) == 1 and not clock:
        return A.Literal("interval", str(units[0][0]), units[0][1])
    if clock:
        units += [(int(n or 0), u) for n, u in zip(clock.groups(), ("hour", "minute", "second"))]
    for table, unit in ((SECONDS, "second"), (MONTHS, "month")):
        if all(u in table for _, u in units):
            return A.Literal("interval", str(sum(n * table[u] for n, u in units)), unit)
    raise SyntaxProblem(f"interval {text!r} mixes days and months")


class Parser:
    def __init__(self, text: str):
        self.toks = tokens(text)
        self.at = 0
        self.nameless = 0  # derived tables without an alias so far
        self.top: A.Expr | None = None  # SELECT TOP n or FIRST n of the query being read

    # tokens

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.toks[self.at + k] if self.at + k < len(self.toks) else ("end", "")

    def is_word(self, *words: str, k: int = 0) -> bool:
        kind, t = self.peek(k)
        return kind == "word" and t.lower() in words

    def is_op(self, *ops: str, k: int = 0) -> bool:
        kind, t = self.peek(k)
        return kind == "op" and t in ops

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def op(self, *ops: str) -> str:
        if self.is_op(*ops):
            self.at += 1
            return self.toks[self.at - 1][1]
        return ""

    def need_word(self, w: str) -> None:
        if not self.word(w):
            raise SyntaxProblem(f"{w.upper()} expected at {self.peek()[1]!r}")

    def need_op(self, o: str) -> None:
        if not self.op(o):
            raise SyntaxProblem(f"{o} expected at {self.peek()[1]!r}")

    def name(self) -> str:
        kind, t = self.peek()
        if kind == "quoted":
            self.at += 1
            return t[1:-1].replace('""', '"')
        if kind == "word":
            self.at += 1
            return t.lower()
        raise SyntaxProblem(f"name expected at {t!r}")

    def alias(self) -> str:
        if self.word("as"):
            return self.name()
        kind, t = self.peek()
        if kind == "quoted" or kind == "word" and t.lower() not in RESERVED:
            return self.name()
        return ""

    def names_in_parens(self) -> tuple[str, ...]:
        if not self.op("("):
            return ()
        out = [self.name()]
        while self.op(","):
            out.append(self.name())
        self.need_op(")")
        return tuple(out)

    # queries

    def statement(self) -> A.Query:
        q = self.query()
        self.op(";")
        if self.peek()[0] != "end":
            raise SyntaxProblem(f"end expected at {self.peek()[1]!r}")
        return q

    def query(self) -> A.Query:
        ctes: list[A.Cte] = []
        if self.word("with"):
            while True:
                name, cols = self.name(), self.names_in_parens()
                self.need_word("as")
                self.need_op("(")
                ctes.append(A.Cte(name, self.query(), cols))
                self.need_op(")")
                if not self.op(","):
                    break
        outer, self.top = self.top, None
        body = self.set_expr(0)
        order: tuple[A.OrderItem, ...] = ()
        limit, offset = self.top, None
        self.top = outer
        if self.word("order"):
            self.need_word("by")
            order = self.order_items()
        while self.is_word("limit", "offset", "fetch"):
            if self.word("limit"):
                limit = None if self.word("all") else self.expr()
            elif self.word("offset"):
                offset = self.expr()
                self.word("rows", "row")
            else:
                self.at += 2  # FETCH FIRST|NEXT
                limit = A.Literal("int", "1") if self.is_word("row", "rows") else self.expr()
                self.word("row", "rows")
                self.need_word("only")
        if isinstance(body, A.Query) and not (order or limit or offset or ctes):
            return body  # parentheses alone leave no trace
        return A.Query(body, order, limit, offset, tuple(ctes))

    def set_expr(self, level: int) -> A.Node:
        """UNION and EXCEPT bind alike, INTERSECT tighter; all to the left."""
        left = self.set_expr(1) if level == 0 else self.set_operand()
        while self.is_word("union", "except") if level == 0 else self.is_word("intersect"):
            op = self.peek()[1].upper()
            self.at += 1
            every = self.word("all")
            self.word("distinct")
            left = A.SetOp(op, every, left, self.set_expr(1) if level == 0 else self.set_operand())
        return left

    def set_operand(self) -> A.Node:
        if self.op("("):
            q = self.query()
            self.need_op(")")
            plain = not (q.order_by or q.limit or q.offset or q.ctes)
            return q.body if plain else q
        return self.select()

    def select(self) -> A.Select:
        self.need_word("select")
        if self.is_word("top", "first") and self.peek(1)[0] == "number":
            self.at += 1
            self.top = self.primary()
        distinct = self.word("distinct")
        self.word("all")
        if self.is_word("top", "first") and self.peek(1)[0] == "number":
            self.at += 1
            self.top = self.primary()
        items = [self.select_item()]
        while self.op(","):
            items.append(self.select_item())
        from_: list[A.FromItem] = []
        if self.word("from"):
            from_.append(self.join_chain())
            while self.op(","):
                from_.append(self.join_chain())
        where = self.expr() if self.word("where") else None
        group: tuple[A.Node, ...] = ()
        if self.word("group"):
            self.need_word("by")
            group = self.group_by()
        having = self.expr() if self.word("having") else None
        return A.Select(tuple(items), tuple(from_), where, group, having, distinct)

    def select_item(self) -> A.Node:
        if self.op("*"):
            return A.Star()
        if self.peek()[0] in ("word", "quoted") and self.is_op(".", k=1) and self.is_op("*", k=2):
            rel = self.name()
            self.at += 2
            return A.Star(rel)
        e = self.expr()
        return A.Item(e, self.alias())

    def join_chain(self) -> A.FromItem:
        left = self.from_item()
        while True:
            if self.word("cross"):
                self.need_word("join")
                left = A.Join("CROSS", left, self.from_item())
                continue
            kind = ""
            if self.word("inner"):
                kind = "INNER"
            elif self.is_word("left", "right", "full"):
                kind = self.peek()[1].upper()
                self.at += 1
                self.word("outer")
            elif self.is_word("join"):
                kind = "INNER"
            if not kind:
                return left
            self.need_word("join")
            right = self.from_item()
            if self.word("using"):
                left = A.Join(kind, left, right, None, self.names_in_parens())
            else:
                self.need_word("on")
                left = A.Join(kind, left, right, self.expr())

    def from_item(self) -> A.FromItem:
        lateral = self.word("lateral")
        if self.op("("):
            if self.is_word("select", "with") or self.is_op("("):
                mark = self.at
                try:
                    q = self.query()
                    self.need_op(")")
                except SyntaxProblem:
                    if lateral:
                        raise
                    self.at = mark
                else:
                    alias = self.alias()
                    if not alias:  # its columns can only be named alone
                        self.nameless += 1
                        alias = f"__d{self.nameless}"
                    return A.Derived(q, alias, self.names_in_parens(), lateral)
            inner = self.join_chain()
            self.need_op(")")
            return inner
        table = self.name()
        alias = self.alias()
        return A.Table(table, alias, self.names_in_parens() if alias else ())

    def group_by(self) -> tuple[A.Node, ...]:
        if self.is_op("(") and self.is_op(")", k=1):
            self.at += 2
            return (A.Grouping("SINGLE"),)
        out: list[A.Node] = []
        while True:
            if self.is_word("grouping") and self.is_word("sets", k=1):
                self.at += 2
                out.append(A.Grouping("GROUPING SETS", self.grouping_sets()))
            elif self.is_word("rollup", "cube") and self.is_op("(", k=1):
                kind = self.peek()[1].upper()
                self.at += 1
                out.append(A.Grouping(kind, self.grouping_sets()))
            else:
                out.append(self.expr())
            if not self.op(","):
                return tuple(out)

    def grouping_sets(self) -> tuple[tuple[A.Expr, ...], ...]:
        self.need_op("(")
        sets: list[tuple[A.Expr, ...]] = []
        while True:
            mark = self.at
            if self.op("("):
                if self.op(")"):
                    sets.append(())
                else:
                    items = [self.expr()]
                    while self.op(","):
                        items.append(self.expr())
                    self.need_op(")")
                    if self.is_op(",", ")"):
                        sets.append(tuple(items))
                    else:  # the parenthesis was part of an expression
                        self.at = mark
                        sets.append((self.expr(),))
            else:
                sets.append((self.expr(),))
            if not self.op(","):
                break
        self.need_op(")")
        return tuple(sets)

    def order_items(self) -> tuple[A.OrderItem, ...]:
        out = []
        while True:
            e = self.expr()
            asc = True if self.word("asc") else False if self.word("desc") else None
            first = None
            if self.word("nulls"):
                first = self.word("first")
                if not first:
                    self.need_word("last")
            out.append(A.OrderItem(e, asc, first))
            if not self.op(","):
                return tuple(out)

    # expressions, weakest first

    def expr(self) -> A.Expr:
        left = self.and_expr()
        while self.word("or"):
            left = A.Binary("OR", left, self.and_expr())
        return left

    def and_expr(self) -> A.Expr:
        left = self.not_expr()
        while self.word("and"):
            left = A.Binary("AND", left, self.not_expr())
        return left

    def not_expr(self) -> A.Expr:
        if self.is_word("not") and not self.is_word("exists", k=1):
            self.at += 1
            return A.Unary("NOT", self.not_expr())
        return self.is_expr()

    def is_expr(self) -> A.Expr:
        e = self.comparison()
        while self.word("is"):
            neg = self.word("not")
            if self.word("null"):
                e = A.IsNull(e, neg)
            elif self.is_word("true", "false", "unknown"):
                e = A.IsBool(e, self.peek()[1].upper(), neg)
                self.at += 1
            else:
                self.need_word("distinct")
                self.need_word("from")
                e = A.IsDistinct(e, self.comparison(), neg)
        return e

    def comparison(self) -> A.Expr:
        left = self.range_expr()
        while self.is_op(*COMPARISONS):
            op = self.op(*COMPARISONS).replace("!=", "<>")
            if self.is_word("any", "some", "all") and self.is_op("(", k=1):
                quantifier = "ALL" if self.is_word("all") else "ANY"
                self.at += 2
                left = A.Quantified(left, op, quantifier, self.query())
                self.need_op(")")
            else:
                left = A.Binary(op, left, self.range_expr())
        return left

    def range_expr(self) -> A.Expr:
        e = self.other_ops()
        while True:
            neg = self.is_word("not") and self.is_word("in", "like", "ilike", "between", k=1)
            self.at += neg
            if self.word("in"):
                self.need_op("(")
                mark = self.at
                try:
                    if self.is_word("select", "with"):
                        raise SyntaxProblem("not a list")
                    items = [self.expr()]
                    while self.op(","):
                        items.append(self.expr())
                    self.need_op(")")
                    e = A.InList(e, tuple(items), neg)
                except SyntaxProblem:
                    self.at = mark
                    e = A.InQuery(e, self.query(), neg)
                    self.need_op(")")
            elif self.is_word("like", "ilike"):
                op = self.peek()[1].upper()
                self.at += 1
                e = A.Binary(op, e, self.other_ops(), neg)
            elif self.word("between"):
                low = self.other_ops()
                self.need_word("and")
                e = A.Between(e, low, self.other_ops(), neg)
            else:
                return e

    def other_ops(self) -> A.Expr:
        left = self.additive()
        while self.is_op("||", "&", "|", "#"):
            op = self.op("||", "&", "|", "#")
            left = A.Binary(op, left, self.additive())
        return left

    def additive(self) -> A.Expr:
        left = self.multiplicative()
        while self.is_op("+", "-"):
            op = self.op("+", "-")
            right = self.multiplicative()
            if isinstance(right, A.Literal) and right.kind == "int" and self.word("days"):
                right = A.Literal("interval", right.value, "day")  # date + 14 days
            left = A.Binary(op, left, right)
        return left

    def multiplicative(self) -> A.Expr:
        left = self.power()
        while self.is_op("*", "/", "%"):
            op = self.op("*", "/", "%")
            left = A.Binary(op, left, self.power())
        return left

    def power(self) -> A.Expr:
        left = self.unary()
        while self.op("^"):
            left = A.Binary("^", left, self.unary())
        return left

    def unary(self) -> A.Expr:
        op = self.op("-", "+", "~", "@", "|/", "||/")
        if op in ("-", "+"):
            return A.Unary(op, self.unary())
        if op:
            return A.Unary(op, self.unary())
        return self.postfix()

    def postfix(self) -> A.Expr:
        e = self.primary()
        while self.op("::"):
            e = A.Cast(e, self.type_name())
        return e

    def type_name(self) -> str:
        t = self.name()
        if t not in TYPES:
            raise SyntaxProblem(f"unknown type {t}")
        if t == "double":
            self.word("precision")
        if t == "character":
            self.word("varying")
        out = TYPES[t]
        if self.op("("):
            args = [self.peek()[1]]
            self.at += 1
            while self.op(","):
                args.append(self.peek()[1])
                self.at += 1
            self.need_op(")")
            if out == "numeric":
                out += f"({','.join(args)})"
        if t == "timestamp" and self.word("without"):
            self.at += 2
        return out

    def primary(self) -> A.Expr:
        kind, t = self.peek()
        if kind == "number":
            self.at += 1
            if re.fullmatch(r"\d+", t):
                n = int(t)
                return A.Literal("int" if n < 2**31 else "bigint" if n < 2**63 else "numeric", t)
            return A.Literal("numeric", t)
        if kind == "string":
            self.at += 1
            return A.Literal("text", t[1:-1].replace("''", "'"))
        if kind == "op" and t == "(":
            self.at += 1
            if self.is_word("select", "with") or self.is_op("("):
                mark = self.at
                try:
                    q = self.query()
                    self.need_op(")")
                    return A.Scalar(q)
                except SyntaxProblem:
                    self.at = mark
            e = self.expr()
            self.need_op(")")
            return e
        if kind == "quoted":
            return self.column()
        if kind != "word":
            raise SyntaxProblem(f"expression expected at {t!r}")
        low = t.lower()
        special = getattr(self, f"p_{low}", None)
        if special and (low in ("case", "null", "true", "false", "exists", "not") or self.peek(1)[0] == "string" or self.is_op("(", k=1)):
            return special()
        if self.is_op("(", k=1):
            return self.function()
        if low in RESERVED:
            raise SyntaxProblem(f"expression expected at {t!r}")
        return self.column()

    def column(self) -> A.Expr:
        first = self.name()
        if self.op("."):
            return A.Column(self.name(), first)
        return A.Column(first)

    def function(self) -> A.Expr:
        name = self.name()
        self.need_op("(")
        args: list[A.Expr] = []
        distinct = star = False
        order: tuple[A.OrderItem, ...] = ()
        if self.op("*"):
            star = True
        elif not self.is_op(")"):
            distinct = self.word("distinct")
            args.append(self.expr())
            while self.op(","):
                args.append(self.expr())
            if self.word("order"):
                self.need_word("by")
                order = self.order_items()
        self.need_op(")")
        where = None
        if self.word("filter"):
            self.need_op("(")
            self.need_word("where")
            where = self.expr()
            self.need_op(")")
        f = A.Func(name, tuple(args), distinct, star, order, where)
        if not self.word("over"):
            return f
        self.need_op("(")
        part: list[A.Expr] = []
        by: tuple[A.OrderItem, ...] = ()
        if self.word("partition"):
            self.need_word("by")
            part.append(self.expr())
            while self.op(","):
                part.append(self.expr())
        if self.word("order"):
            self.need_word("by")
            by = self.order_items()
        frame: list[str] = []
        while not self.is_op(")"):
            frame.append(self.peek()[1].upper())
            self.at += 1
        self.need_op(")")
        return A.Window(f, tuple(part), by, " ".join(frame))

    # forms with their own syntax

    def p_null(self) -> A.Expr:
        self.at += 1
        return A.Literal("null", "")

    def p_true(self) -> A.Expr:
        self.at += 1
        return A.Literal("bool", "true")

    def p_false(self) -> A.Expr:
        self.at += 1
        return A.Literal("bool", "false")

    def _typed_string(self, kind: str) -> A.Expr:
        if self.peek(1)[0] != "string":
            return self.function()
        self.at += 2
        return A.Literal(kind, self.toks[self.at - 1][1][1:-1].replace("''", "'"))

    def p_date(self) -> A.Expr:
        return self._typed_string("date")

    def p_timestamp(self) -> A.Expr:
        return self._typed_string("timestamp")

    def p_interval(self) -> A.Expr:
        lit = self._typed_string("interval")
        if isinstance(lit, A.Literal):
            if self.is_word(*UNITS):
                unit = self.peek()[1].lower()
                self.at += 1
                if self.op("("):  # a precision says nothing about the value
                    self.at += 1
                    self.need_op(")")
                return A.Literal("interval", lit.value.strip(), unit)
            return interval(lit.value)
        return lit

    def p_exists(self) -> A.Expr:
        self.at += 1
        self.need_op("(")
        q = self.query()
        self.need_op(")")
        return A.Exists(q)

    def p_not(self) -> A.Expr:
        self.at += 1
        e = self.p_exists()
        return A.Exists(e.query, True)  # type: ignore[attr-defined]

    def p_case(self) -> A.Expr:
        self.at += 1
        operand = None if self.is_word("when") else self.expr()
        whens = []
        while self.word("when"):
            cond = self.expr()
            self.need_word("then")
            whens.append((cond, self.expr()))
        otherwise = self.expr() if self.word("else") else None
        self.need_word("end")
        return A.Case(operand, tuple(whens), otherwise)

    def p_cast(self) -> A.Expr:
        self.at += 2
        e = self.expr()
        self.need_word("as")
        t = self.type_name()
        self.need_op(")")
        return A.Cast(e, t)

    def p_position(self) -> A.Expr:
        self.at += 2
        what = self.other_ops()
        self.need_word("in")
        within = self.other_ops()
        self.need_op(")")
        return A.Position(what, within)

    def p_extract(self) -> A.Expr:
        self.at += 2
        field = self.name()
        self.need_word("from")
        e = self.expr()
        self.need_op(")")
        return A.Extract(field, e)

    def p_trim(self) -> A.Expr:
        self.at += 2
        side, what = "BOTH", None
        if self.is_word("both", "leading", "trailing"):
            side = self.peek()[1].upper()
            self.at += 1
        if not self.word("from"):
            e = self.expr()
            if not self.word("from"):
                self.need_op(")")
                return A.Trim(side, None, e)
            what = e
        e = self.expr()
        self.need_op(")")
        return A.Trim(side, what, e)

    def p_substring(self) -> A.Expr:
        self.at += 2
        e = self.expr()
        start = length = None
        if self.op(","):
            start = self.expr()
            if self.op(","):
                length = self.expr()
        else:
            while self.is_word("from", "for"):
                if self.word("from"):
                    start = self.expr()
                else:
                    self.at += 1
                    length = self.expr()
        self.need_op(")")
        return A.Substring(e, start, length)


#: A limit in the manner of row numbers, which stands behind a finished statement; a negative one is none.
ROWNUM = re.compile(r";?\s*\bwhere\s+rownum\s*<=\s*(-?\d+)\s*;?\s*\Z", re.I)


def parse(text: str) -> A.Query:
    tail = ROWNUM.search(text)
    if tail:
        text = text[: tail.start()] + (f" LIMIT {tail[1]}" if tail[1][0] != "-" else "")
    return Parser(text).statement()


def parse_view(text: str) -> tuple[str, tuple[str, ...], A.Query] | None:
    """(name, column names, query) of CREATE VIEW; None if the text is something else."""
    p = Parser(text)
    if not p.word("create"):
        return None
    if p.word("or"):
        p.need_word("replace")
    p.word("temporary", "temp")
    if not p.word("view"):
        return None
    name, columns = p.name(), p.names_in_parens()
    p.need_word("as")
    return name, columns, p.statement()
