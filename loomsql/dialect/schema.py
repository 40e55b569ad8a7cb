"""Schemas: from CREATE TABLE text, from Spark's tables, and the Spark types of both."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from .binder import Relation
from .parser import TYPES, tokens

SPARK = {
    "int": T.IntegerType(), "bigint": T.LongType(), "numeric": T.DecimalType(38, 10), "double": T.DoubleType(), "text": T.StringType(), "bool": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(), "interval": T.DayTimeIntervalType(), "bytea": T.BinaryType(), "other": T.StringType(),
}


def logical(t: T.DataType) -> str:
    """The dialect's type of a Spark type; empty for those it doesn't have (arrays, maps, structs)."""
    if isinstance(t, T.DecimalType):
        return f"numeric({t.precision},{t.scale})"
    for kind, classes in (
        ("int", (T.ByteType, T.ShortType, T.IntegerType)), ("bigint", (T.LongType,)), ("double", (T.FloatType, T.DoubleType)), ("text", (T.StringType,)), ("bool", (T.BooleanType,)),
        ("date", (T.DateType,)), ("timestamp", (T.TimestampType, T.TimestampNTZType)), ("interval", (T.DayTimeIntervalType,)), ("interval(ym)", (T.YearMonthIntervalType,)), ("bytea", (T.BinaryType,)), ("null", (T.NullType,)),
    ):
        if isinstance(t, classes):
            return kind
    return ""


def relation_of(name: str, schema: T.StructType, key: tuple[str, ...] = ()) -> Relation:
    return Relation(name, tuple((f.name, logical(f.dataType) or "other") for f in schema), key)


def struct_of(r: Relation) -> T.StructType:
    return T.StructType([T.StructField(n, T.DecimalType(*map(int, t[8:-1].split(","))) if t.startswith("numeric(") and "," in t else SPARK[t.partition("(")[0]]) for n, t in r.columns])


def parse_ddl(text: str) -> dict[str, Relation]:
    """Tables of the CREATE TABLE statements in a text; all other statements are passed over. A primary key may be composite."""
    out: dict[str, Relation] = {}
    for statement in re.split(r";", text):
        if not re.match(r"\s*(?:--[^\n]*\s*)*create\s+(?:temp(?:orary)?\s+)?table\b", statement, re.I):
            continue
        toks = [t for _, t in tokens(statement)]
        low = [t.lower() for t in toks]
        at = low.index("table") + 1
        if low[at : at + 3] == ["if", "not", "exists"]:
            at += 3
        name = _name(toks[at])
        parts, depth, part = [], 0, []
        for t in toks[at + 1 :]:
            depth += (t == "(") - (t == ")")
            if t == "(" and depth == 1 or t == ")" and depth == 0:
                continue
            if t == "," and depth == 1:
                parts.append(part)
                part = []
            elif depth >= 1:
                part.append(t)
        parts.append(part)
        columns, key = [], ()
        for p in parts:
            if not p:
                continue
            words = [x.lower() for x in p]
            if words[0] in ("primary", "foreign", "unique", "check", "constraint", "key", "index"):
                if "primary" in words:
                    inside = p[words.index("(", words.index("primary")) + 1 : words.index(")", words.index("primary"))]
                    key = tuple(_name(x) for x in inside if x != ",")
                continue
            kind = TYPES.get(words[1]) or {"varchar2": "text", "tinyint": "int", "mediumint": "int", "year": "int", "clob": "text"}.get(words[1])
            kind = kind or "other"  # a column no expression takes
            if kind == "numeric" and len(p) > 5 and p[2] == "(" and p[4] == ",":
                kind = f"numeric({p[3]},{p[5]})"
            columns.append((_name(p[0]), kind))
            if "primary" in words:
                key = (_name(p[0]),)
        out[name] = Relation(name, tuple(columns), key)
    return out


def _name(t: str) -> str:
    return t[1:-1].replace('""', '"') if t.startswith('"') else t.strip("`[]").lower()
