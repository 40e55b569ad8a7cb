"""Parser, binder and rewriting."""

import pytest

from loomsql.dialect import ast as A
from loomsql.dialect import render_pg
from loomsql.dialect.binder import Binder, BindProblem, widen
from loomsql.dialect.engine import Engine
from loomsql.dialect.equivalence import logics_agree
from loomsql.dialect.parser import SyntaxProblem, parse
from loomsql.dialect.schema import parse_ddl
from loomsql.plans.constructs import CONSTRUCTS
from loomsql.plans.tpch import TEXTS

SCHEMA = parse_ddl("""
    -- two tables
    CREATE TABLE r (a int PRIMARY KEY, b varchar(20), c double precision, d date, e timestamp);
    INSERT INTO r VALUES (1);
    CREATE TABLE s (a int, k bigint, "Odd Name" text, price numeric(10,2), PRIMARY KEY (a, k));
""")


def bind(text):
    return Binder(SCHEMA).query(parse(text))


@pytest.mark.parametrize("text", [t for _, t, *_ in CONSTRUCTS] + list(TEXTS.values()))
def test_text_round_trip(text):
    tree = parse(text)
    assert parse(render_pg.query(tree)) == tree


def test_precedence():
    e = parse("SELECT NOT a = 1 AND b OR c + 2 * 3 ^ 2 < d || 'x'").body.items[0].e
    assert isinstance(e, A.Binary) and e.op == "OR"
    assert render_pg.expr(e) == "NOT a = 1 AND b OR c + 2 * 3 ^ 2 < d || 'x'"


@pytest.mark.parametrize("text", ["SELECT", "SELECT 1 FROM", "SELECT 1 +", "SELECT CASE WHEN 1 END", "SELECT 'open", "SELECT a b c"])
def test_syntax_problems(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT x FROM r", "SELECT a FROM r, s", "SELECT r.a FROM r AS q", "SELECT 1 FROM r, r", "SELECT b FROM r GROUP BY c", "SELECT a FROM r WHERE count(*) > 1",
        "SELECT a FROM r UNION SELECT b FROM r", "SELECT a, b FROM r UNION SELECT a FROM r", "SELECT b + 1 FROM r", "SELECT a FROM r WHERE b", "SELECT sum(max(a)) FROM r",
        "SELECT DISTINCT a FROM r ORDER BY b", "SELECT a FROM r ORDER BY 3", "SELECT (SELECT a, b FROM r) FROM s", "SELECT q.a FROM r JOIN s ON r.a = t.a, r AS t", "SELECT a FROM nowhere",
        "SELECT a FROM s GROUP BY k", "SELECT a FROM r LIMIT a", "SELECT nofunction(a) FROM r",
    ],
)
def test_bind_problems(text):
    with pytest.raises(BindProblem):
        bind(text)


def test_names_and_types():
    got = bind("SELECT a, max(c), CASE WHEN true THEN 1 END, d + 1, e - e, extract(year FROM d), position(b IN b), trim(b), EXISTS (SELECT 1 FROM s), CAST(NULL AS bigint) FROM r GROUP BY a")
    assert [n for n, _ in got.columns] == ["a", "max", "case", "", "", "extract", "position", "btrim", "exists", "int8"]
    assert [t for _, t in got.columns] == ["int", "double", "int", "date", "interval", "numeric", "int", "text", "bool", "bigint"]


def test_using_merges_columns():
    got = bind('SELECT * FROM r JOIN s USING (a)')
    assert [n for n, _ in got.columns] == ["a", "b", "c", "d", "e", "k", "Odd Name", "price"]
    bind("SELECT a FROM r LEFT JOIN s USING (a) WHERE s.a IS NULL")
    for bad in ("SELECT 1 FROM r JOIN s USING (b)", "SELECT 1 FROM r FULL JOIN s USING (a)"):
        with pytest.raises(BindProblem):
            bind(bad)


def test_intervals():
    lit = lambda t: parse(f"SELECT INTERVAL '{t}'").body.items[0].e
    assert lit("3 days") == A.Literal("interval", "3", "day") and lit("1 day 02:03:04") == A.Literal("interval", str(86400 + 7384), "second") and lit("1 year 2 months") == A.Literal("interval", "14", "month")
    for bad in ("1 month 1 day", "soon", "3 parsecs"):
        with pytest.raises(SyntaxProblem):
            lit(bad)


def test_views(spark):
    engine = Engine(spark, {"t": spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")})
    engine.create_view("CREATE VIEW v (k) AS SELECT a + 1, b FROM t WHERE a > 1")
    assert [tuple(r) for r in engine.sql("SELECT k, b FROM v").collect()] == [(3, "y")]
    with pytest.raises(ValueError):
        engine.create_view("SELECT 1")


def test_keys_and_ddl():
    assert SCHEMA["s"].key == ("a", "k") and SCHEMA["s"].columns[2] == ("Odd Name", "text") and SCHEMA["s"].columns[3][1] == "numeric(10,2)"
    bind("SELECT b, c FROM r GROUP BY a")
    with pytest.raises(BindProblem):
        bind('SELECT price FROM s GROUP BY a')  # part of a key determines nothing


def test_widening():
    assert widen("int", "bigint") == "bigint" and widen("bigint", "numeric") == "numeric" and widen("null", "text") == "text"
    with pytest.raises(BindProblem):
        widen("text", "int")


def test_correlation_and_shadowing():
    b = bind("SELECT a FROM r WHERE EXISTS (SELECT 1 FROM s WHERE s.k = r.a AND a = 3)")
    inner = b.query.body.where.query.body.where
    assert inner.right.left == A.Column("a", "s")


def test_rewrites(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (None, "y")], "a int, b string")
    engine = Engine(spark, {"t": df})
    one = lambda t: engine.sql(t).first()[0]
    assert one("SELECT 7 / 2") == 3 and one("SELECT -7 / 2") == -3 and one("SELECT 2 ^ 3") == 8 and one("SELECT 6 # 3") == 5
    assert one("SELECT 3 IN (SELECT a FROM t)") is None and one("SELECT 1 IN (SELECT a FROM t)") is True and one("SELECT 3 NOT IN (SELECT a FROM t WHERE a > 0)") is True
    assert one("SELECT 5 > ALL (SELECT a FROM t)") is None and one("SELECT 0 > ALL (SELECT a FROM t)") is False and one("SELECT 0 < ALL (SELECT a FROM t WHERE a > 9)") is True
    assert one("SELECT NULL > ANY (SELECT a FROM t WHERE a > 9)") is False
    assert [r[0] for r in engine.sql("SELECT a FROM t ORDER BY a").collect()] == [1, 2, None]
    assert [r[0] for r in engine.sql("SELECT a FROM t ORDER BY a DESC").collect()] == [None, 2, 1]
    assert one("SELECT substring('abcdef' FROM -1 FOR 4)") == "ab"
    assert str(one("SELECT DATE '2020-02-28' + INTERVAL '1' day")) == "2020-02-29 00:00:00"
    assert one("SELECT CAST(2.5 AS int)") == 3 and one("SELECT string_agg(b, '+') FROM t") == "x+y"
    assert engine.sql("SELECT 1 FROM t WHERE a > 9 GROUP BY ()").count() == 1
    assert engine.sql("SELECT a FROM t ORDER BY a LIMIT (SELECT count(*) FROM t) - 1").count() == 2


def test_plans_scale(spark, data):
    """Filters and columns reach the scan; equality with any is a join; bounds are aggregated, not compared row by row."""
    plan = lambda t: Engine.over(spark, data, t).sql(t)._jdf.queryExecution().executedPlan().toString()
    p = plan("SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49" in p and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p
    p = plan("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
    assert "LeftSemi" in p and "NestedLoop" not in p
    p = plan("SELECT o_orderkey, o_totalprice > ALL (SELECT c_acctbal FROM customer) AS v FROM orders")
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_logics():
    good = "SELECT 1 FROM r WHERE a IN (SELECT a FROM s) AND NOT (b = 'x') AND c IS NULL AND EXISTS (SELECT 1 FROM s WHERE a NOT IN (SELECT k FROM s))"
    assert logics_agree(parse(good))
    for bad in ("a NOT IN (SELECT a FROM s)", "NOT EXISTS (SELECT 1 FROM s WHERE a NOT IN (SELECT k FROM s))", "b = 'x' OR a NOT IN (SELECT a FROM s)", "a NOT IN (1, (SELECT 2 FROM s WHERE a NOT IN (SELECT a FROM r)))"):
        assert not logics_agree(parse(f"SELECT 1 FROM r WHERE {bad}"))
    with pytest.raises(ValueError):
        logics_agree(parse("SELECT 1 UNION SELECT 2"))


def test_not_in_is_no_broadcast(spark, data):
    """Without broadcasts by size the inner side of NOT IN is sorted and merged, whatever its size."""
    from loomsql.dialect.engine import run

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for text in ("o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", "o_custkey <> ALL (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"):
            plan = run(spark, data, f"SELECT o_orderkey FROM orders WHERE {text}")._jdf.queryExecution().sparkPlan().toString()
            assert "SortMergeJoin" in plan and "LeftAnti" in plan and "BroadcastHashJoin" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("text", ["SELECT * FROM orders WHERE o_orderdate > 'x' + 1", "SELECT n_name FROM nation WHERE n_nationkey = n_name", "SELECT n_nationkey FROM nation WHERE n_nationkey * 1.5 > 'abc'"])
def test_literals_that_do_not_fit(spark, data, text):
    from loomsql.dialect.binder import BindProblem
    from loomsql.dialect.engine import run

    with pytest.raises(BindProblem):
        run(spark, data, text)
