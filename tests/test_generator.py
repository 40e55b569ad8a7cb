"""Generation, recognition, replay, training and the constraint environment."""

import random

import pytest

from loomsql.dialect import ast as A
from loomsql.dialect import render_pg, training
from loomsql.dialect.constraint import ACTIONS, ConstraintEnv, range_reward
from loomsql.dialect.engine import Engine
from loomsql.dialect.generator import Call, NotRecognised, Walker, generate, recognise, replay
from loomsql.dialect.grammar import GRAMMAR, LEAST_CALLS
from loomsql.dialect.parser import parse
from loomsql.dialect.schema import parse_ddl
from loomsql.sources import corpus, sinks

SCHEMA = parse_ddl("""
    CREATE TABLE n (k int PRIMARY KEY, name text, region int);
    CREATE TABLE o (id bigint PRIMARY KEY, total double precision, day timestamp, status text);
""")


def test_grammar_closes():
    assert all(c in GRAMMAR for options in GRAMMAR.values() for calls in options.values() for c in calls)
    assert all(v < 100 for options in LEAST_CALLS.values() for v in options.values())


@pytest.mark.parametrize("stir", [2, 5, 8])
def test_round_trips(stir):
    for seed in range(60):
        q, path = generate(SCHEMA, seed, stir)
        assert generate(SCHEMA, seed, stir)[0] == q
        assert parse(render_pg.query(q)) == q
        assert replay(SCHEMA, path) == q
        try:
            bound, found = recognise(SCHEMA, q)
        except NotRecognised:
            continue
        assert replay(SCHEMA, found) == bound


def test_size_follows_stir():
    mean = lambda stir: sum(generate(SCHEMA, s, stir)[0].count() for s in range(40)) / 40
    assert mean(2) < mean(6) < mean(9)


def test_generated_queries_are_valid(spark, data):
    engine = Engine(spark, {n: spark.read.parquet(f"{data}/{n}.parquet") for n in ("nation", "region", "customer", "orders")})
    for n, df in engine.tables.items():
        df.createOrReplaceTempView(n)
    for seed in range(40):
        spark.sql(engine.to_spark(generate(engine.schema, seed, 5)[0])).schema  # analysis raises if it isn't


def test_recognition_refuses():
    for text in ("WITH x AS (SELECT 1 AS a FROM n) SELECT a FROM x", "SELECT k FROM n UNION ALL SELECT k FROM n", "SELECT rank() OVER (ORDER BY k) AS r FROM n"):
        with pytest.raises((NotRecognised, KeyError)):
            recognise(SCHEMA, parse(text))


def test_training(spark):
    made = [render_pg.query(generate(SCHEMA, s, 4)[0]) for s in range(30)] + ["not SQL at all", None]
    df = spark.createDataFrame([(t,) for t in made], "text string")
    for kind in training.KINDS:
        w = training.transitions(df, "text", SCHEMA, kind)
        sums = w.groupBy("ctx", "before").sum("weight").collect()
        assert sums and all(abs(r[2] - 1) < 1e-9 for r in sums)
    assert training.unrecognised(df, "text", SCHEMA).first()["n"] >= 1
    w = training.transitions(df, "text", SCHEMA, "function")
    model = training.Model.of(w)
    a = training.bulk_generate(spark, SCHEMA, 40, 4, model, seed=7, partitions=3).orderBy("query_no").collect()
    b = training.bulk_generate(spark, SCHEMA, 40, 4, model, seed=7, partitions=5).orderBy("query_no").collect()
    assert a == b and len(a) == 40
    assert "->" in sinks.weights_graph(w)


def test_asking_chooser():
    calls = []

    def answer(question):
        calls.append(question)
        return question.rsplit(" of ", 1)[1].split(",")[0].rstrip("?") if len(calls) != 1 else "nonsense"

    q, _ = Walker(SCHEMA, training.AskingChooser(answer)).query()
    assert q.count() > 1 and "nonsense" in calls[1]
    with pytest.raises(NotRecognised):
        Walker(SCHEMA, training.AskingChooser(lambda _: "nonsense")).query()


def test_constraint_env(spark, data):
    assert range_reward(25, 20, 30) == 5 and range_reward(None, 20, 30) == -5 and range_reward(10**9, 20, 30) == -5 and -5 < range_reward(31, 20, 30) < 0
    env = ConstraintEnv(Engine(spark, {n: spark.read.parquet(f"{data}/{n}.parquet") for n in ("nation", "region")}), seed=3)
    r = random.Random(2)
    for _ in range(200):
        open_ = [k for k, m in enumerate(env.mask) if m]
        k = min(open_, key=lambda k: (LEAST_CALLS[ACTIONS[k][0]].get(ACTIONS[k][1], 0), r.random()))
        _, reward, ended, cut, info = env.step(k)
        if ended or cut:
            break
    assert ended and 1 <= reward <= 11 and info["query"].count() > 3
    env.reset()
    shut = env.mask.index(False)
    assert env.step(shut)[3]


def test_sources(spark, tmp_path):
    (tmp_path / "q.sql").write_text("-- first\nSELECT 1;\n\nSELECT 2\nFROM n;\n")
    assert sorted(r[0] for r in corpus.sql_corpus(spark, str(tmp_path / "q.sql")).collect()) == ["SELECT 1", "SELECT 2\nFROM n"]
    (tmp_path / "q.json").write_text('[{"db_id": "a", "query": "SELECT 1", "question": "one?"}]')
    assert corpus.question_corpus(spark, str(tmp_path / "q.json")).first()["query"] == "SELECT 1"
    (tmp_path / "d.sql").write_text("CREATE TABLE x (a int, b text);")
    assert corpus.ddl_schema(spark, str(tmp_path / "d.sql"))["x"].columns == (("a", "int"), ("b", "text"))
    df = spark.createDataFrame([("SELECT\n 1",)], "sql string")
    sinks.write_sql(df, "sql", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "SELECT 1;"


def test_every_construct_is_generated():
    seen, limits = set(), 0
    for seed in range(1500):
        q, path = generate(SCHEMA, seed, 6)
        seen |= {(calls[-1], o) for calls, o in training._taken(path)}
        for n in q.walk():
            if isinstance(n, A.Query):
                inside = n.body
                while isinstance(inside, A.Query):
                    limits += n.limit is not None and inside.limit is not None or bool(n.order_by and inside.order_by)
                    inside = inside.body
    assert not limits
    assert {(f, o) for f, options in GRAMMAR.items() for o in options} - seen <= {("expr_date", "column")}  # no dates in this schema


def test_full_contexts_tell_parameters_apart():
    deep = Call("expr_int", "grouped ")
    assert training.context("full", [deep]) == "expr_int(grouped)" != training.context("full", [Call("expr_int")])
    assert training.context("stacked functions", ["query", "body", "query"]) == "query/body/query"
    assert training.context("full by depth", ["query", deep]) == "expr_int(grouped)@2"


def test_corpus_forms():
    parsed = parse("select k from n order by k; where rownum <= 5;")
    assert parsed.limit == A.Literal("int", "5") and parse("select k from n where rownum <= -1").limit is None
    assert parse("select a from (select k as a from n) where a > 1").body.from_[0].alias
    assert parse("select date '1998-12-01' - interval '66' day (3) as d from n") == parse("select date '1998-12-01' - interval '66' day as d from n")
    assert parse_ddl("create table t (a int, b time, c text)")["t"].columns == (("a", "int"), ("b", "other"), ("c", "text"))
