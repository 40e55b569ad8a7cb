import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomsql.llm import copies
from loomsql.llm.statements import Profile, canonical, select_list, sliced


def test_select_list():
    cut = lambda t: [t[a:b].strip() for a, b in zip(select_list(t.encode()), select_list(t.encode())[1:])]
    assert cut("SELECT a, f(b, c) FROM t, u") == ["a", ", f(b, c)"]
    assert cut("select distinct a,'x, y',b from t") == ["a", ",'x, y'", ",b"]
    assert cut("WITH q AS (SELECT x, y FROM t) SELECT a, b FROM q") == ["a", ", b"]
    assert cut("(SELECT a, b FROM t) UNION SELECT c, d FROM u") == ["c", ", d"]
    assert cut("(SELECT a, b FROM t)") == ["a", ", b"]
    assert cut("SELECT 1") == ["1"] and select_list(b"no list") == [] and select_list(b"") == []


def same(a, b):
    p = Profile(pa.array([a, b]))
    one, two = np.array([0]), np.array([1])
    assert bool(p.equal(one, p, two)[0]) == (p.signature[0] == p.signature[1]) == (canonical(a) == canonical(b))
    return canonical(a) == canonical(b)


def test_what_counts():
    assert same("SELECT a, b FROM t", 'select  "B",\n[a] from `T` ;')
    assert same("SELECT DISTINCT a, b FROM t", "select distinct b, a from t")
    assert same("SELECT a FROM t WHERE x = 'it''s'", 'select a from t where x = "its"')
    assert not same("SELECT a, b FROM t GROUP BY a, b", "SELECT a, b FROM t GROUP BY b, a")
    assert not same("SELECT a FROM t WHERE x = 1.5", "SELECT a FROM t WHERE x = 15")
    assert not same("SELECT a FROM t WHERE x > -1", "SELECT a FROM t WHERE x > 1")
    assert not same("SELECT ab, c FROM t", "SELECT a, bc FROM t")
    assert not same("SELECT a, a, b FROM t", "SELECT a, b, b FROM t")
    assert not same("SELECT DISTINCT a FROM t", "SELECT a FROM t")
    assert not same("SELECT (SELECT a, b FROM t) FROM u", "SELECT (SELECT b, a FROM t) FROM u")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbB ,'\"();\n sS", max_size=12).map(lambda s: f"select {s} from t"), min_size=2, max_size=6))
def test_profile_agrees_with_canonical_form(texts):
    p = Profile(pa.array(texts))
    forms = [canonical(t) for t in texts]
    n = len(texts)
    i, j = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    assert p.equal(i, p, j).tolist() == [forms[a] == forms[b] for a, b in zip(i, j)]


def brute(rows):
    groups = {}
    for i, d, q in rows:
        if i is not None and q is not None and canonical(q):
            groups.setdefault((None if d is None else d.strip().lower(), canonical(q)), []).append(i)
    return sorted((min(v), x) for v in groups.values() for x in v if x != min(v))


ROWS = [
    (5, "A", "SELECT x, y FROM t"), (3, " a ", "select y, x from T;"), (9, None, "SELECT x, y FROM t"), (8, None, "select x,y from t"), (2, "a", None), (1, "a", "   \n"),
    (7, "a", "SELECT x FROM t"), (7, "a", "SELECT x FROM t"), (None, "a", "SELECT x FROM t"), (11, "b", "SELECT x, y FROM t"), (12, "b", "select [y],[x] from t " + " " * 100_000),
]
SCHEMA = "query_id long, db_id string, query string, kept_id string, sig string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_collapse_edge_cases(spark):
    df = frame(spark, ROWS)
    got = copies.collapse(df, "query_id", "query", copies.trimmed_lower(F.col("db_id")))
    assert sorted(tuple(r) for r in got.collect()) == brute(ROWS) == [(3, 5), (8, 9), (11, 12)]
    counts = {r[0]: r[1] for r in copies.copy_counts(df, "query_id", "query", copies.trimmed_lower(F.col("db_id"))).collect()}
    assert counts == {3: 2, 8: 2, 7: 2, 11: 2}
    assert copies.collapse(frame(spark, []), "query_id", "query").count() == 0


def test_hot_group(spark):
    r = random.Random(1)
    rows = [(i, "d", r.choice(["SELECT a,b FROM t", "select b , a from t", "SELECT [a], b\nFROM t;"]) if i % 3 == 0 else f"SELECT c{i % 500} FROM t") for i in range(3000)]
    got = copies.collapse(frame(spark, rows).repartition(7), "query_id", "query", copies.trimmed_lower(F.col("db_id")))
    assert sorted(tuple(x) for x in got.collect()) == brute(rows)


def test_local_classes_survive_collisions(monkeypatch):
    """Rows of one signature that aren't the same statement are kept apart, and bounded memory loses none."""
    real = Profile.__init__

    def colliding(self, texts):
        real(self, texts)
        self.signature = self.signature * 0

    monkeypatch.setattr(Profile, "__init__", colliding)
    for keep in (copies.KEEP_BYTES, 0):
        monkeypatch.setattr(copies, "KEEP_BYTES", keep)
        batch = pa.RecordBatch.from_arrays([pa.array([4, 2, 3, 1]), pa.nulls(4, pa.string()), pa.array(["select a", "select b", "SELECT A", "SELECT b"])], names=["id", "key", "text"])
        out = [r for b in copies.local_classes(iter([batch, batch])) for r in b.to_pylist()]
        reps = {r["rep_id"]: r["text"] for r in out if r["kind"] == "r"}
        for r in out:
            if r["kind"] == "e":
                assert canonical({1: "select b", 2: "select b", 3: "select a", 4: "select a"}[r["copy_id"]]) == canonical(reps[r["rep_id"]])
        assert {r["rep_id"] for r in out if r["kind"] == "r"} | {r["copy_id"] for r in out if r["kind"] == "e"} == {1, 2, 3, 4}


def test_slices():
    texts = ["x" * n for n in (3, 9, 0, 30, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["id", "text"])
    parts = list(sliced(iter([batch, batch.slice(0, 0), batch.slice(2, 3)]), 1, 10))
    assert [p.num_rows for p in parts] == [1, 2, 1, 4, 1, 1, 1] and [x for p in parts[:4] for x in p.column(1).to_pylist()] == texts
    assert Profile(batch.slice(1, 2).column(1)).signature.tolist() == Profile(pa.array(texts[1:3])).signature.tolist()


def test_verify():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["select a", "select b", None]), pa.array(["SELECT a", "select c", None])], names=["rep_id", "text", "first_text"])
    assert next(copies.verify(iter([batch]))).to_pylist() == [{"rep_id": 1, "text": None, "ok": True}, {"rep_id": 2, "text": "select b", "ok": False}, {"rep_id": 3, "text": None, "ok": True}]


def test_found_on_the_tables(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/spider_query.parquet").select("query_id", "db_id", "query").collect()]
    assert sorted(tuple(r) for r in copies.p2_found(spark, data).collect()) == brute(rows)


def test_hot_groups_in_parts(spark, monkeypatch):
    """A group with more rows than one task should hold."""
    monkeypatch.setattr(copies, "HOT", 4)
    rows = [(i, None if i % 2 else "db", "SELECT a, b FROM t" if i % 3 else f"SELECT {i % 50} FROM t") for i in range(600)]
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "query_id long, db_id string, query string").repartition(12)
    least = {}
    for i, d, q in rows:
        least.setdefault((d, q), i)
    want = {(least[d, q], i) for i, d, q in rows if least[d, q] != i}
    assert {tuple(r) for r in copies.collapse(df, "query_id", "query", copies.trimmed_lower(F.col("db_id"))).collect()} == want
