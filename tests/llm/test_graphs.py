import random
from collections import Counter

import numpy as np
import pytest

from loomsql.llm import copies, neardup, splits
from loomsql.llm.contraction import components, least_of_component
from loomsql.llm.statements import canonical
from loomsql.session import Scratch


def union_find(edges):
    p = {}

    def f(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = f(a), f(b)
        p[max(a, b)] = min(a, b)
    return {x: f(x) for x in p}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 300)], [(random.Random(k).randrange(200), random.Random(k + 999).randrange(200)) for k in range(160)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges + [(None, 3)] if edges else [], "u long, v long")
    labels = components(df, Scratch(spark, "test"))
    got = {tuple(r) for r in least_of_component(labels).collect()}
    want = {(r, x) for x, r in union_find([e for e in edges if e[0] != e[1]]).items() if x != r}
    assert got == want


ROWS = [
    (1, "A", "SELECT x, y FROM t"), (2, "b ", "select y, x from t"), (3, "b", "SELECT 2"), (4, "c", "select  2;"), (5, "d", "SELECT 9"), (6, None, "SELECT 9"), (7, None, "SELECT 77"), (8, None, "select 77"),
    (9, "e", None), (10, "f", " "), (11, None, None), (12, "a", "SELECT x, y FROM t"), (None, "zz", "SELECT x, y FROM t"),
]


def test_linked_sources(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "query_id long, db_id string, query string, key string")
    got = splits.linked_sources(df, "query_id", "query", "db_id")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "b"), ("a", "c")]
    assert splits.linked_sources(df.limit(0), "query_id", "query", "db_id").count() == 0


def test_split_records(spark):
    r = random.Random(5)
    rows = [(i, r.choice([f"db{r.randrange(40)}", None, f" DB{r.randrange(40)} "]) if i % 3 else "hot", f"SELECT {r.randrange(4000)} FROM t") for i in range(6000)]
    df = spark.createDataFrame(rows, "query_id long, db_id string, query string")
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2), (None, 0.5), ("nothing", None)], "split_name string, proportion double")
    out = splits.split_records(df.filter("query_id < 300 or db_id is null"), targets, "query_id", "query", "db_id").collect()
    units = {}
    for x in out:
        units.setdefault(x["unit"], set()).add(x["split_name"])
    assert all(len(v) == 1 for v in units.values()) and len({x["query_id"] for x in out}) == len(out)
    share = Counter(x["split_name"] for x in out)["train"] / len(out)
    assert abs(share - 0.8) < 0.02
    df = spark.createDataFrame(ROWS, "query_id long, db_id string, query string")
    by = {x["query_id"]: x["unit"] for x in splits.split_records(df, targets, "query_id", "query", "db_id").collect()}
    assert by[1] == by[2] == by[3] == by[4] == by[12] and by[5] == by[6] and by[7] == by[8] != by[6] and by[11] not in (by[7], by[9])
    none = splits.split_records(df, targets.filter("proportion > 9"), "query_id", "query", "db_id").collect()
    assert {x["split_name"] for x in none} == {None}
    assert splits.split_records(df.limit(0), targets, "query_id", "query", "db_id").count() == 0


def test_place():
    placed = splits.place([("a", 50), ("b", 30), ("c", 10), ("d", 10)], {"train": 80.0, "test": 20.0})
    assert Counter({s: sum(w for n, w in (("a", 50), ("b", 30), ("c", 10), ("d", 10)) if placed[n] == s) for s in ("train", "test")}) == {"train": 80, "test": 20}


def test_p3_on_the_tables(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/spider_query.parquet").select("query_id", "db_id", "query").collect()]
    held = {}
    for _, d, q in rows:
        if d is not None and q is not None and q.strip():
            held.setdefault(canonical(q), set()).add(d.strip().lower())
    uf = union_find([(min(v), x) for v in held.values() for x in v])
    assert {tuple(r) for r in splits.p3_found(spark, data).collect()} == {(r, x) for x, r in uf.items() if x != r}


def brute_near(rows, size, threshold, min_words):
    sets = {i: neardup.WORDS.findall(t.lower()) for i, t in rows if i is not None and t is not None}
    sets = {i: neardup.shingles(" ".join(w), size) for i, w in sets.items() if len(w) >= min_words}
    ids = sorted(sets)
    uf = union_find([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if neardup.jaccard(sets[a], sets[b]) >= threshold])
    return {(r, x) for x, r in uf.items() if x != r}


def test_near_duplicates(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(0, 300, 3):
        base = r.sample(words, 40)
        rows.append((i, " ".join(base)))
        for k in (1, 2):
            base = base[:]
            for _ in range(r.choice((0, 2, 6))):
                base[r.randrange(40)] = r.choice(words)
            rows.append((i + k, " ".join(base).upper()))
    rows += [(1000, None), (1001, ""), (1002, "too short"), (None, rows[0][1]), (1003, " ".join(words * 50)), (1004, rows[0][1]), (1004, rows[0][1])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc long, body string, words string")
    got = neardup.near_duplicates(df, "doc", "body", 3, 0.6, 20)
    assert {tuple(x) for x in got.collect()} == brute_near(dict(rows).items(), 3, 0.6, 20)
    assert neardup.near_duplicates(df.limit(0), "doc", "body").count() == 0


def test_hot_bucket(spark):
    """A third of the texts differ from one another in one word."""
    base = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(base[:20] + [f"x{i}"] + base[20:])) if i % 3 == 0 else (i, " ".join(f"r{i}_{k}" for k in range(25))) for i in range(900)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc long, body string"), "doc", "body", 3, 0.6, 20)
    assert sorted(tuple(x) for x in got.collect()) == [(0, i) for i in range(3, 900, 3)]


def test_hot_bucket_links_far_members(spark):
    """Texts far from the least id and their predecessors, near one member of a big family only, join it."""
    c = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(c[:20] + [f"x{i}"] + c[20:])) for i in range(200)]
    rows += [(1000 + j, " ".join(c[2:20] + [f"x{3 * j + 40}"] + c[20:25] + [f"z{j}_{k}" for k in range(4)])) for j in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc long, body string"), "doc", "body", 3, 0.6, 20, bands=12, rows=1)
    want = brute_near(rows, 3, 0.6, 20)
    assert len(want) == 239 and {tuple(x) for x in got.collect()} == want


def test_crowded_batches(spark, monkeypatch):
    """Buckets split in every batch: links between texts of different parts, and texts that link to one member only."""
    monkeypatch.setattr(neardup, "CROWD", 4)
    c = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(c[:20] + [f"x{i}"] + c[20:])) for i in range(200)]
    rows += [(1000 + j, " ".join(c[2:20] + [f"x{3 * j + 40}"] + c[20:25] + [f"z{j}_{k}" for k in range(4)])) for j in range(40)]
    key, who = neardup.parted(np.array([5] * 9 + [7], np.uint64), np.arange(10))
    assert list(who) == [*range(10), 0] and key[9] == 7 and key[10] == 5 and len(set(key[:9])) == 1 and key[0] != 5
    frame = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc long, body string").repartition(6)
    assert {tuple(x) for x in neardup.near_duplicates(frame, "doc", "body", 3, 0.6, 20, bands=12, rows=1).collect()} == brute_near(rows, 3, 0.6, 20)


def test_templated_texts(spark):
    """Texts of one template: each has one partner above the threshold, all others are just below it."""
    r = random.Random(1)
    rows = [(2 * p + q, " ".join([f"c{k}" for k in range(80)] + [f"p{p}_{k}" for k in range(3)] + [f"q{p}_{q}_{k}" for k in range(18)])) for p in range(150) for q in range(2)]
    r.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc long, body string"), "doc", "body", 3, 0.69, 20)
    assert {tuple(x) for x in got.collect()} == {(2 * p, 2 * p + 1) for p in range(150)}


def test_sketch_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.8):
        common = r.integers(1, 2**63, 200)
        n = int(200 * (1 - share) / (2 * share))
        a, b = (np.concatenate([common, r.integers(1, 2**63, n)]).astype(np.uint64) for _ in range(2))
        row = np.repeat([0, 1], [len(a), len(b)])
        s = neardup.sketches(row, np.concatenate([a, b]), 2, 240)
        assert (s != neardup.NONE).all()
        errors.append(abs((s[0] == s[1]).mean() - 200 / (200 + 2 * n)))
    assert max(errors) < 0.12
    one = neardup.sketches(np.array([0]), np.array([5], np.uint64), 1, 16)
    assert (one != neardup.NONE).all()


def test_bucket_pairs_across_batches():
    import pyarrow as pa

    key = [1] * 5 + [2] * 80 + [3]
    ids = list(range(5)) + list(range(100, 180)) + [999]
    whole = lambda cuts: {tuple(p.values()) for b in neardup.bucket_pairs(pa.RecordBatch.from_arrays([pa.array(key[a:b], pa.int64()), pa.array(ids[a:b], pa.int64())], names=["key", "id"]) for a, b in zip(cuts, cuts[1:])) for p in b.to_pylist()}
    want = {(a, b) for a in range(5) for b in range(a + 1, 5)} | {(a, b) for a in range(100, 180) for b in range(a + 1, 180) if b - a <= neardup.WINDOW or a == 100}
    for cuts in ([0, 86], [0, 3, 40, 41, 86], list(range(87))):
        assert whole(cuts) == want


def test_p5_on_the_tables(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/spider_query.parquet").select("query_id", "query").collect()]
    assert {tuple(r) for r in neardup.p5_found(spark, data).collect()} == brute_near(rows, 3, 0.6, 20)


def test_statement_in_many_sources(spark, monkeypatch):
    monkeypatch.setattr(copies, "HOT", 10)
    rows = [(i, f"db{i % 60:02d}" if i % 7 else None, "SELECT a,b FROM t" if i % 3 else f"SELECT {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "query_id long, db_id string, query string").repartition(5)
    held = {d for _, d, q in rows if d and "a,b" in q}
    got = {tuple(r) for r in splits.linked_sources(df, "query_id", "query", "db_id").collect()}
    assert got == {(min(held), d) for d in held if d != min(held)}
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, proportion double")
    units = {x["unit"] for x in splits.split_records(df, targets, "query_id", "query", "db_id").collect() if x["query_id"] % 3}
    assert len(units) == 1
