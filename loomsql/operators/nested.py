"""Deeply nested JSON records as related flat tables, by shared inlining.

``schema_graph`` reads which elements occur under which, over all records. ``inline_plan`` decides from that graph which
elements get tables of their own: roots, repeated elements, elements shared by several parents, and one element of every
cycle that has none yet; all other elements are singletons and become columns of the table they lie in. ``shred`` writes
the rows: each knows its record, its path, and relation and path of the row it lies in.

Elements are named by the member that leads to them; rules may name them by shape instead, and only elements named by
``keep`` then get rows, everything between them being passed through.

Depth costs no stack: values are walked with an explicit one, and texts nested deeper than the JSON library allows are
parsed by a loop. Records never meet each other, so there is no shuffle but that of the small graph.

Defined results: null, empty and invalid texts (also NaN and Infinity) have no rows; of repeated members of an object the
last counts; records that occur twice have their rows twice; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A graph with more edges than this isn't one of element names but of data used as names.
MAX_EDGES = 100_000


@dataclass(frozen=True)
class Rule:
    """Names an element by shape: all conditions that are set must hold."""

    name: str
    member: str | None = None  # the member that leads to it, or to the array it is an element of
    in_array: bool | None = None
    has: str | None = None  # it is an object with this member
    owner_has: str | None = None  # the object it is a member of has this member
    not_null: bool = False

    def fits(self, value: object, member: str, in_array: bool, owner: object) -> bool:
        return (
            (self.member is None or self.member == member)
            and (self.in_array is None or self.in_array == in_array)
            and (self.has is None or isinstance(value, dict) and self.has in value)
            and (self.owner_has is None or isinstance(owner, dict) and self.owner_has in owner)
            and not (self.not_null and value is None)
        )


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _int(digits: str) -> float | int:
    return int(digits) if len(digits) < 300 else float(digits)


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_int=_int)
_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null", re.ASCII)
_ATOMS = {"true": True, "false": False, "null": None}


def parse(text: str) -> object:
    """The value of a JSON text; ValueError if it isn't one."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> object:
    """The same without recursion."""
    space, at, n = _SPACE.match, 0, len(text)
    root: list = []
    stack: list = [root]
    keys: list = [None]
    expect = "value"
    while True:
        at = space(text, at).end()
        if at >= n:
            break
        ch, top = text[at], stack[-1]
        if expect in ("value", "value or ]"):
            if ch == "]" and expect == "value or ]":
                stack.pop(), keys.pop()
                at, expect = at + 1, "more"
                continue
            if ch in "[{":
                new: object = [] if ch == "[" else {}
                at += 1
            elif ch == '"':
                new, at = json.decoder.scanstring(text, at + 1, True)
            else:
                m = _ATOM.match(text, at)
                if not m:
                    raise ValueError(at)
                new, at = _ATOMS[m[0]] if m[0] in _ATOMS else float(m[0]), m.end()
            if isinstance(top, list):
                top.append(new)
            else:
                top[keys[-1]] = new
            if ch in "[{":
                stack.append(new), keys.append(None)
                expect = "value or ]" if ch == "[" else "key or }"
            else:
                expect = "more"
        elif expect in ("key", "key or }"):
            if ch == "}" and expect == "key or }":
                stack.pop(), keys.pop()
                at, expect = at + 1, "more"
                continue
            if ch != '"':
                raise ValueError(at)
            keys[-1], at = json.decoder.scanstring(text, at + 1, True)
            at = space(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(at)
            at, expect = at + 1, "value"
        else:
            if top is root:
                raise ValueError(at)
            closing = "]" if isinstance(top, list) else "}"
            if ch == ",":
                at, expect = at + 1, "value" if isinstance(top, list) else "key"
            elif ch == closing:
                stack.pop(), keys.pop()
                at += 1
            else:
                raise ValueError(at)
    if expect != "more" or stack[-1] is not root:
        raise ValueError(n)
    return root[0]


def _names(value: object, member: str, in_array: bool, owner: object, rules: tuple[Rule, ...]) -> list[str]:
    return [r.name for r in rules if r.fits(value, member, in_array, owner)]


def walk(root: object, rules: tuple[Rule, ...], keep: frozenset[str] | None) -> Iterator[tuple]:
    """(element, path, parent element, parent path, value, ordinal, repeated) in document order of every named element."""
    by_member: dict[str | None, list[Rule]] = {}
    for r in rules:
        by_member.setdefault(r.member, []).append(r)
    of_shape = by_member.pop(None, [])
    rank = {id(r): k for k, r in enumerate(rules)}
    plain = keep is not None  # then a value without a rule of its own that holds nothing needs no look
    stack: list[tuple] = [(root, "$", "", "", "", False, None, 0)]
    while stack:
        value, path, parent, parent_path, member, in_array, owner, ordinal = stack.pop()
        here = by_member.get(member)
        found = here + of_shape if here else of_shape
        names = [r for r in found if r.fits(value, member, in_array, owner)] if found else found
        if len(names) > 1:
            names = sorted(names, key=lambda r: rank[id(r)])
        labels = [r.name for r in names]
        if not plain and not labels and not isinstance(value, list) and (isinstance(value, dict) or in_array):
            labels = [member or "root"]
        for name in labels:
            if keep is None or name in keep:
                yield name, path, parent, parent_path, value, ordinal, in_array
                parent, parent_path = name, path
        if isinstance(value, dict):
            for k in reversed(value):
                v = value[k]
                if not plain or k in by_member or isinstance(v, (dict, list)):
                    stack.append((v, f"{path}/{k}", parent, parent_path, k, False, value, 0))
        elif isinstance(value, list):
            inner = "" if in_array else member
            for k in range(len(value) - 1, -1, -1):
                v = value[k]
                if not plain or inner in by_member or isinstance(v, (dict, list)):
                    stack.append((v, f"{path}/{k}", parent, parent_path, inner, True, owner, k))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, object]]:
    for i, text in enumerate(batch.column(column).to_pylist()):
        if text:
            try:
                value = parse(text)
            except ValueError:
                continue
            yield i, value


def schema_graph(df: DataFrame, json_col: str, rules: tuple[Rule, ...] = (), keep: frozenset[str] | None = None) -> DataFrame:
    """(parent, child, repeated, n): how often an element occurs under another, and whether as one of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for _, value in _texts(batch, 0):
                inside: Counter = Counter()
                for name, _, parent, parent_path, _, _, repeated in walk(value, rules, keep):
                    inside[parent, parent_path, name] += 1
                    seen[parent, name, repeated or inside[parent, parent_path, name] > 1] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([_utf8(k[0]) for k in keys], pa.string()), pa.array([_utf8(k[1]) for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())], names=["parent", "child", "repeated", "n"])

    parts = df.select(F.col(json_col).alias("text")).filter("text is not null").mapInArrow(run, "parent string, child string, repeated boolean, n bigint")
    return parts.groupBy("parent", "child").agg(F.bool_or("repeated").alias("repeated"), F.sum("n").alias("n"))


def inline_plan(edges: list[tuple[str, str, bool]]) -> tuple[set[str], dict[str, str]]:
    """(elements with tables of their own, inlined element -> the element it is a column of)."""
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    tables: set[str] = set()
    for parent, child, repeated in edges:
        parents.setdefault(child, set()).add(parent)
        children.setdefault(parent, set()).add(child)
        if repeated or parent == "" or parent == child:
            tables.add(child)
    tables |= {c for c, p in parents.items() if len(p) > 1}
    inlined: dict[str, str] = {}
    for name in sorted(parents):
        if name in tables:
            continue
        chain, at = {name}, next(iter(parents[name]))
        while at not in tables and at in parents and at not in chain:
            chain.add(at)
            at = next(iter(parents[at]))
        if at in chain:  # a cycle of singletons: this element opens it
            tables.add(name)
    for name in parents:
        if name not in tables:
            inlined[name] = next(iter(parents[name]))
    return tables, inlined


def _utf8(s: str) -> str:
    return s.encode("utf-8", "replace").decode()


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return None if value is None else _utf8(value)
    return _utf8(json.dumps(value, ensure_ascii=False))


def columns_of(value: object, rules: tuple[Rule, ...], tables: set[str], named: frozenset[str] | None) -> dict[str, str | None]:
    """Scalars of an element and of all singletons inlined in it, however deep, by dotted name."""
    if not isinstance(value, dict):
        return {"value": _text(value)}
    out: dict[str, str | None] = {}
    stack = [("", value)]
    while stack:
        prefix, obj = stack.pop()
        for k, v in obj.items():
            if isinstance(v, list):
                continue
            if isinstance(v, dict):
                names = _names(v, k, False, obj, rules) or ([k] if named is None else [])
                if not any(n in tables for n in names):
                    stack.append((f"{prefix}{k}.", v))
                continue
            out[_utf8(prefix + k)] = _text(v)
    return out


def shred(df: DataFrame, id_col: str, json_col: str, rules: tuple[Rule, ...] = (), keep: frozenset[str] | None = None, tables: set[str] | None = None, columns: frozenset[str] | None = None) -> DataFrame:
    """(record_id, relation, node_path, parent_relation, parent_path, ordinal, columns, inlined) of every element with a table.

    ``inlined`` holds, by element name, the JSON text of the singleton elements that lie in the row. ``tables`` is taken
    from the data's own graph if it isn't given. ``columns`` names the elements whose columns are wanted (all if it isn't given).
    """
    if tables is None:
        edges = schema_graph(df, json_col, rules, keep).limit(MAX_EDGES + 1).collect()
        if len(edges) > MAX_EDGES:
            raise ValueError(f"more than {MAX_EDGES} pairs of element names; name the elements by rules")
        tables, _ = inline_plan([(r["parent"], r["child"], r["repeated"]) for r in edges])
    own = frozenset(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_map = pa.map_(pa.string(), pa.string())
        for batch in batches:
            rec, rows = [], []
            for i, value in _texts(batch, 1):
                at: dict[tuple[str, str], list] = {}
                for name, path, parent, parent_path, v, ordinal, _ in walk(value, rules, keep):
                    if name in own:
                        row = [name, path, parent, parent_path, ordinal, columns_of(v, rules, own, keep) if columns is None or name in columns else {}, {}]
                        at[name, path] = row
                        rec.append(i)
                        rows.append(row)
                    else:  # a singleton: a column of the nearest row, known there by its name
                        row = at[name, path] = at[parent, parent_path]
                        row[6][_utf8(name)] = _utf8(path) if v is None else f"{_utf8(path)}\n{_text(v)}"
            ids = batch.column(0).take(pa.array(rec, pa.int64()))
            utf = lambda k: pa.array([_utf8(r[k]) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([ids, utf(0), utf(1), utf(2), utf(3), pa.array([r[4] for r in rows], pa.int32()), pa.array([list(r[5].items()) for r in rows], text_map), pa.array([list(r[6].items()) for r in rows], text_map)], names=["record_id", "relation", "node_path", "parent_relation", "parent_path", "ordinal", "columns", "inlined"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("record_id"), F.col(json_col).alias("text")).filter("text is not null")
    return rows.mapInArrow(run, f"record_id {kind}, relation string, node_path string, parent_relation string, parent_path string, ordinal int, columns map<string,string>, inlined map<string,string>")


def relation(rows: DataFrame, name: str) -> DataFrame:
    """The flat table of one element, whether it has rows of its own or is inlined in others."""
    whole = rows.filter(F.col("relation") == name).select("record_id", "node_path", "parent_path", "ordinal", "columns")
    hit = F.col("inlined")[name]
    path = F.split_part(hit, F.lit("\n"), F.lit(1))
    value = F.when(F.contains(hit, F.lit("\n")), F.substring(hit, F.length(path) + 2, F.length(hit)))
    parts = rows.filter(hit.isNotNull()).select("record_id", path.alias("node_path"), F.col("node_path").alias("parent_path"), F.lit(0).alias("ordinal"), F.create_map(F.lit("value"), value).alias("columns"))
    return whole.unionByName(parts)


#: The elements of parsed statements: queries are known by their body, sort items and common table expressions by their array.
STATEMENT_RULES = (
    Rule("limit", member="limit", in_array=False, owner_has="body", not_null=True),
    Rule("cte", member="cte_tables", in_array=True),
    Rule("order", member="order_by", in_array=True),
    Rule("query", has="body"),
)
STATEMENT_ELEMENTS = frozenset(r.name for r in STATEMENT_RULES)


def statement_rows(df: DataFrame, columns: frozenset[str] | None = None) -> DataFrame:
    return shred(df, "sql_id", "ast_json", STATEMENT_RULES, STATEMENT_ELEMENTS, columns=columns)
