"""Shared inlining of nested records."""

import json

import pytest

from loomsql.operators.nested import STATEMENT_ELEMENTS, STATEMENT_RULES, _parse_deep, inline_plan, parse, relation, schema_graph, shred, walk
from loomsql.plans import queries


def brute(i, v, path="$", par="", owner=None, member="", in_array=False):
    out = []
    if member == "limit" and not in_array and isinstance(owner, dict) and "body" in owner and v is not None:
        out.append((i, "limit", path, par))
        par = path
    if member == "cte_tables" and in_array:
        out.append((i, "cte", path, par))
        par = path
    if member == "order_by" and in_array:
        a = v.get("asc") if isinstance(v, dict) else None
        a = {"true": True, "false": False}.get(a.lower()) if isinstance(a, str) else a
        out.append((i, {None: "order_default", True: "order_asc", False: "order_desc"}[a], path, par))
        par = path
    if isinstance(v, dict) and "body" in v:
        out.append((i, "query", path, par))
        par = path
    if isinstance(v, dict):
        for k, x in v.items():
            out += brute(i, x, f"{path}/{k}", par, v, k)
    elif isinstance(v, list):
        for k, x in enumerate(v):
            out += brute(i, x, f"{path}/{k}", par, owner, member, True)
    return out


def test_found_matches_brute_force(spark, data):
    want = []
    for r in spark.read.parquet(f"{data}/sample_sqls.parquet").select("sql_id", "ast_json").collect():
        try:
            want += brute(r[0], json.loads(r[1])) if r[1] else []
        except ValueError:
            pass
    got = [tuple(r) for r in queries()["p4_found"](spark, data).collect()]
    assert sorted(got) == sorted(want) and want


def test_edge_cases(spark, tmp_path):
    q = '{"Query": {"body": {}, "limit": {"body": 1, "limit": 5}, "order_by": [{"asc": "TRUE"}, {"asc": null}, 7], "with": {"cte_tables": [{"query": {"body": 2}}]}}}'
    deep = '{"a":' * 30_000 + '{"body": 1}' + "}" * 30_000
    rows = [(1, q), (2, ""), (3, None), (4, '{"body": NaN}'), (5, '{"body": 1'), (6, "null"), (7, '{"body": 1, "x": "{\\"body\\": 2}"}'), (1, q), (8, deep), (9, '{"limit": 3, "order_by": null}')]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "sql_id long, ast_json string, relation string")
    df.write.parquet(str(tmp_path / "sample_sqls.parquet"))
    got = [tuple(r) for r in queries()["p4_found"](spark, str(tmp_path)).collect()]
    want = 2 * brute(1, json.loads(q)) + [(7, "query", "$", ""), (8, "query", "$" + "/a" * 30_000, "")]
    assert sorted(got) == sorted(want)
    empty = spark.createDataFrame([], "sql_id long, ast_json string")
    empty.write.parquet(str(tmp_path / "none" / "sample_sqls.parquet"))
    assert queries()["p4_found"](spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("text", ["[1,]", '{"a":}', "[1", '{"a" 1}', "1 2", "[NaN]", "", '{"a":1,}', "[01]", "tru", '"\t"', "{1:2}", "]"])
def test_both_parsers_refuse(text):
    for f in (parse, _parse_deep):
        with pytest.raises(ValueError):
            f(text)


def test_parsers_agree():
    for text in ('{"a":[1,2.5,"x\\u00e9",{"b":null,"c":[]},{}],"d":true}', " [ ] ", "-1.5e3", '"s"', '{"a":1,"a":2}'):
        assert parse(text) == _parse_deep(text)


def test_plan():
    edges = [("", "root", False), ("root", "one", False), ("one", "leaf", False), ("root", "many", True), ("many", "shared", False), ("one", "shared", False), ("leaf", "loop", False), ("loop", "back", False), ("back", "loop", False)]
    tables, inlined = inline_plan(edges)
    assert {"root", "many", "shared", "loop"} <= tables and inlined["one"] == "root" and inlined["leaf"] == "one" and "back" in inlined


def test_generic_shredding(spark):
    df = spark.createDataFrame([(1, '{"id": 7, "who": {"name": "x", "age": 3}, "tags": [{"t": "a"}, {"t": "b"}]}')], "id long, js string")
    g = {(r["parent"], r["child"]): r["repeated"] for r in schema_graph(df, "js").collect()}
    assert g["root", "tags"] is True and g["root", "who"] is False
    rows = shred(df, "id", "js")
    tags = relation(rows, "tags").orderBy("ordinal").collect()
    assert [t["columns"]["t"] for t in tags] == ["a", "b"] and {t["parent_path"] for t in tags} == {"$"}
    root = rows.filter("relation = 'root'").first()
    assert root["columns"]["id"] == "7" and root["columns"]["who.name"] == "x"


def test_walk_order():
    v = json.loads('{"body": {"order_by": [1, 2]}, "limit": 4}')
    assert [(n, p) for n, p, *_ in walk(v, STATEMENT_RULES, STATEMENT_ELEMENTS)] == [("query", "$"), ("order", "$/body/order_by/0"), ("order", "$/body/order_by/1"), ("limit", "$/limit")]


def test_singletons_of_any_depth_are_columns(spark):
    from loomsql.operators.nested import STATEMENT_ELEMENTS, STATEMENT_RULES, shred

    df = spark.createDataFrame([(1, '{"body": 1, "a": {"b": {"c": {"d": {"e": 5}}}}}')], "id long, j string")
    row = shred(df, "id", "j", STATEMENT_RULES, STATEMENT_ELEMENTS).first()
    assert row["columns"] == {"body": "1", "a.b.c.d.e": "5"}
    assert shred(df, "id", "j", STATEMENT_RULES, STATEMENT_ELEMENTS, columns=frozenset(("order",))).first()["columns"] == {}
