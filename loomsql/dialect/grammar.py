"""The grammar of what is generated and recognised: functions, their options, and what each option calls.

The table serves three ends: it names the decisions a path is made of, it gives the least number of calls every option
still needs (which steers size), and the walker takes its options from it.
"""

from __future__ import annotations

TYPES = ("int", "bigint", "numeric", "text", "bool", "date", "timestamp", "interval")
NUMBERS = ("int", "bigint", "numeric")
NARROWER = {"numeric": ("bigint", "int"), "bigint": ("int",)}
COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")
DATE_FIELDS = ("day", "week", "month", "quarter", "year", "isodow", "isoyear", "decade", "century", "millennium")
SPAN_FIELDS = ("day", "hour", "minute", "month", "quarter", "year", "decade", "century", "millennium")
TIME_FIELDS = ("minute", "hour", *DATE_FIELDS)

#: Aggregates by result type: name -> argument types.
AGGREGATES: dict[str, dict[str, tuple[str, ...]]] = {
    "int": {n: ("int",) for n in ("min", "max", "bit_and", "bit_or", "bit_xor")},
    "bigint": {"count": ("any",), "sum": ("bigint",), "regr_count": ("numeric", "numeric"), **{n: ("bigint",) for n in ("min", "max", "bit_and", "bit_or", "bit_xor")}},
    "numeric": {
        **{n: ("numeric",) for n in ("min", "max", "avg", "sum", "var_samp", "variance", "var_pop", "stddev", "stddev_samp", "stddev_pop")},
        **{n: ("numeric", "numeric") for n in ("corr", "covar_pop", "covar_samp", "regr_sxx", "regr_sxy", "regr_syy", "regr_avgx", "regr_avgy", "regr_intercept", "regr_r2", "regr_slope")},
    },
    "text": {"string_agg": ("text", "text"), "min": ("text",), "max": ("text",)},
    "bool": {n: ("bool",) for n in ("bool_and", "bool_or", "every")},
    "date": {"min": ("date",), "max": ("date",)},
    "timestamp": {"min": ("timestamp",), "max": ("timestamp",)},
    "interval": {n: ("interval",) for n in ("min", "max", "sum", "avg")},
}


def _numbers(t: str) -> dict[str, tuple[str, ...]]:
    e = f"expr_{t}"
    out = {f"op {o}": (e, e) for o in ("+", "-", "*", "/")} | {"unary -": (e,), "unary +": (e,), "unary @": (e,)}
    if t != "numeric":
        out |= {f"op {o}": (e, e) for o in ("&", "|", "#")} | {"unary ~": (e,)}
    else:
        out |= {"op ^": (e, e), "unary ||/": (e,), "unary |/": (e,), "extract timestamp": ("expr_timestamp",), "extract date": ("expr_date",), "extract interval": ("expr_interval",)}
    if t == "int":
        out["position"] = ("expr_text", "expr_text")
    return out


def _expressions(t: str) -> dict[str, tuple[str, ...]]:
    e = f"expr_{t}"
    out: dict[str, tuple[str, ...]] = {
        "literal": (), "column": (), "typed null": (), "case": (e, "expr_bool"), "simple case": (e, "expr_int", "expr_int"), "scalar": ("query",), "aggregate": ("aggregate",),

    }
    out |= {f"narrow {n}": (f"expr_{n}",) for n in NARROWER.get(t, ())}
    if t in NUMBERS:
        out |= _numbers(t)
    elif t == "text":
        out |= {"concat": (e, e), "trim": (e,), "trim what": (e, e), "substring": (e, "expr_int", "expr_int")}
    elif t == "date":
        out |= {"date + int": (e, "expr_int"), "int + date": ("expr_int", e), "date - int": (e, "expr_int")}
    elif t == "timestamp":
        out |= {"+ interval": (e, "expr_interval"), "- interval": (e, "expr_interval"), "date + interval": ("expr_date", "expr_interval")}
    elif t == "interval":
        out |= {"op +": (e, e), "op -": (e, e), "unary -": (e,), "ts - ts": ("expr_timestamp", "expr_timestamp")}
    else:
        out |= {"and": (e, e), "or": (e, e), "not": (e,), "is null": ("expr_int",), "distinct": ("expr_int", "expr_int"), "between": ("expr_int",) * 3, "like": ("expr_text", "expr_text")}
        out |= {"exists": ("query",), "in list": ("expr_int", "expr_int"), "in query": ("expr_int", "query"), "any": ("expr_int", "query"), "all": ("expr_int", "query")}
        out |= {"compare": ("expr_int", "expr_int")}
    return out


GRAMMAR: dict[str, dict[str, tuple[str, ...]]] = {
    "query": {"plain": ("body",), "ordered": ("body", "order")},
    "limit": {"none": (), "one": (), "n": ()},
    "body": {"select": ("select",), "union": ("body", "body"), "intersect": ("body", "body"), "except": ("body", "body"), "query": ("query",)},
    "select": {"all": ("from", "where", "group", "items"), "distinct": ("from", "where", "group", "items")},
    "from": {"one": ("from_item",), "more": ("from_item", "from")},
    "from_item": {"table": (), "derived": ("query",), "join": ("from_item", "from_item", "expr_bool")},
    "where": {"none": (), "where": ("expr_bool",)},
    "group": {"none": (), "columns": (), "single": (), "rollup": (), "cube": (), "grouping sets": (), "mixed": ()},
    "having": {"none": (), "having": ("expr_bool",)},
    "items": {"star": (), "relation star": (), "list": ("expr_int",)},
    "order": {"output": (), "expression": ("expr_int",)},
    "aggregate": {"call": ("expr_int",), "distinct": ("expr_int",), "star": ()},
    **{f"expr_{t}": _expressions(t) for t in TYPES},
}


def least_calls() -> dict[str, dict[str, int]]:
    """For every option the least number of calls until it is done, by relaxation."""
    best = {f: 10**6 for f in GRAMMAR}
    changed = True
    while changed:
        changed = False
        for f, options in GRAMMAR.items():
            n = min(1 + sum(best[c] for c in calls) for calls in options.values())
            if n < best[f]:
                best[f], changed = n, True
    return {f: {o: sum(best[c] for c in calls) for o, calls in options.items()} for f, options in GRAMMAR.items()}


LEAST_CALLS = least_calls()
