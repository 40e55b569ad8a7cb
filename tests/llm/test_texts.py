import os
import random

import pytest

from loomsql.llm import leaks, residue, subset, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file here")


@needs_vocabulary
@pytest.mark.parametrize(("chunk", "overlap"), [(500, 100), (300, 299), (8_192, 1_024), (65_536, 2_048)])
def test_encoding(spark, chunk, overlap):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    prose = "The grammar's options aren't all open; größere Zahlen wie 12345 bleiben. 統計查詢 ¿por qué? <|endoftext|>\r\n\t  "
    docs = [(1, prose * 40), (2, ""), (3, None), (4, "ab " * 3000), (5, "x" * 9000), (6, " " * 30_000 + "a"), (7, "\n" * 4000), (8, "a\x1c\x1d b" * 2000), (9, "統計" * 5000 + "é" * 3000), (1, prose * 40), (None, prose * 30), (10, " ")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, ids string")
    got = tokens.encode_corpus(df, "doc_id", "text", chunk=chunk, overlap=overlap).collect()
    want = sorted((-1 if i is None else i, t.encode(x, add_special_tokens=False).ids if x else []) for i, x in docs)
    assert sorted((-1 if r[0] is None else r[0], list(r[1])) for r in got) == want
    by = {r[0]: list(r[1]) for r in got}
    assert all(tokens.decode(by[i]).decode() == (x or "") for i, x in docs)
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
def test_p6_gives_a_row_for_each_document(spark, data):
    rows = tokens.p6_ids(spark, data).collect()
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts) and all(tokens.decode(list(r[1])).decode() == (texts[r[0]] or "") for r in rows)


def test_leaks(spark):
    r = random.Random(2)
    words = [f"word{k}" for k in range(500)]
    items = [(i, " ".join(r.sample(words, 30))) for i in range(8)] + [(90, None), (91, "short text"), (92, ""), (None, "x " * 30)]
    docs = [(100, None), (101, ""), (102, " "), (None, items[0][1])]
    for k in range(60):
        own = r.sample(words, 60)
        item = r.choice(items[:8])[1].split()
        n = r.choice((8, 11, 12, 13, 20))
        at = r.randrange(0, 30 - n)
        docs.append((k, " - ".join(own[:20]) + "  " + "_".join(w.upper() for w in item[at : at + n]) + "!\n" + " ".join(own[20:])))
    docs.append((200, " ".join(words * 40) + " " + items[3][1]))
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, hash string")
    e = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, item_text string, text string")
    grams = {}
    for i, t in items:
        w = leaks.words_of(t or "")
        for k in range(len(w) - 11):
            if i is not None:
                grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for i, t in docs:
        w = leaks.words_of(t or "")
        want |= {(i, x) for k in range(len(w) - 11) for x in grams.get(tuple(w[k : k + 12]), ()) if i is not None}
    assert want
    for bound in (leaks.MAX_SENT, 0):  # with and without the hashes sent to the tasks
        before, leaks.MAX_SENT = leaks.MAX_SENT, bound
        texts, leaks.MAX_TEXT = leaks.MAX_TEXT, leaks.MAX_TEXT * bool(bound)
        try:
            for needed in (1, len(leaks.MASKS)):
                got = {(x["doc_id"], x["item_id"]) for x in leaks.find_leaks(d, e, masks_needed=needed).filter("run >= 12").collect()}
                assert got == want
        finally:
            leaks.MAX_SENT, leaks.MAX_TEXT = before, texts
    assert leaks.find_leaks(d.limit(0), e).count() == 0 and leaks.find_leaks(d, e.limit(0)).count() == 0


def test_leaks_tolerate_substitutions(spark):
    w = [f"w{k}" for k in range(40)]
    changed = [x if k % 9 != 4 else "other" for k, x in enumerate(w)]
    d = spark.createDataFrame([(1, " ".join(changed))], "doc_id long, text string")
    e = spark.createDataFrame([(7, " ".join(w))], "item_id long, item_text string")
    got = leaks.find_leaks(d, e).first()
    assert got["run"] == 8 and got["overlap"] >= 30


def test_overlap_is_the_longest_of_its_diagonal(spark):
    """A poor hit comes first; and a passage with more than 40 substitutions on a side."""
    w = [f"w{k}" for k in range(700)]
    poor = ["a"] * 3 + w[:3] + ["b"] + w[4:8] + ["c"] + w[9:12] + [f"y{k}" for k in range(9)] + w[21:41]
    long = [x if k % 8 != 4 else "other" for k, x in enumerate(w)]
    d = spark.createDataFrame([(1, " ".join(poor)), (2, " ".join(long))], "doc_id long, text string")
    e = spark.createDataFrame([(7, " ".join(w))], "item_id long, item_text string")
    got = {r["doc_id"]: (r["run"], r["overlap"]) for r in leaks.find_leaks(d, e).collect()}
    assert got == {1: (20, 20), 2: (7, 700)}


def test_seeds_miss_no_overlap():
    """Every pattern of substitutions of an overlap of 12 to 27 words, ends equal, at most 15 % substituted."""
    from itertools import combinations

    for n in range(12, 28):
        for k in range(int(0.15 * n + 1e-9) + 1):
            for wrong in combinations(range(1, n - 1), k):
                assert any(not {p + q for q in mask} & set(wrong) for mask in leaks.SEEDS for p in range(n - mask[-1]))


def test_every_sixth_word_substituted(spark):
    w = [f"w{k}" for k in range(47)]
    changed = [x if k % 6 != 5 else f"other{k}" for k, x in enumerate(w)]
    one = [[f"v{j}x{k}" for k in range(12)] for j in range(12)]
    docs = [(0, " ".join(changed))] + [(j, " ".join(x if k != j else "other" for k, x in enumerate(one[j]))) for j in range(1, 11)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(0, " ".join(w))] + [(j, " ".join(one[j])) for j in range(1, 11)], "item_id long, item_text string")
    got = sorted(tuple(r) for r in leaks.find_leaks(d, e).select("doc_id", "item_id", "overlap").collect())
    assert got == [(0, 0, 47)] + [(j, j, 12) for j in range(1, 11)]


RESIDUE = [
    "{{ title }}\n{{body}}", "Dear [YOUR NAME], thank you for asking about {% table %}.", "Login · Register · Help\nERROR 404: NOT FOUND.", "502 Bad Gateway\n\nnginx-like proxy at edge-36",
    "Lorem ipsum dolor sit amet consectetur. Ut enim ad minim veniam.", "Oh no! Your dashboard took too long to respond.\n47621b85", "Please enable JavaScript to view this page.", "Bitte JavaScript aktivieren, um fortzufahren.",
    "Seite nicht gefunden (404). Bitte prüfen Sie die Adresse.", "Content coming soon\n© Example Project", "Your session has expired. Log in again to see this page.", "Hello &lt;user&gt;, your run ${run.id} finished at @@date@@.",
]
CONTENT = [
    "The prompt template keeps the slot [INSERT result] until the model fills it with the table name.", 'How do I stop the proxy from sending "502 Bad Gateway" when race has 50 rows?',
    "Users saw Error 404: not found. until we raised the time limit to 30 s.", "EXPLAIN SELECT a FROM t WHERE d_year = [YEAR] AND b IN (1, 2)", 'ERROR: column "a" must appear in the GROUP BY clause (3 cases).',
    "The race table has 40 rows.\nPlease enable JavaScript to view this page.", 'Why does the chooser print "lorem ipsum dolor sit" for this column?', "Readers without scripts get this line: please enable JavaScript to continue.",
    "統計查询返回1811行，列为空。", "{{ title }}\nWe measured 506 queries per second at level 63, down from 80509.", "SELECT count(*) FROM x;",
]


def test_residue(spark):
    rows = [(i, t) for i, t in enumerate(RESIDUE)] + [(100 + i, t) for i, t in enumerate(CONTENT)] + [(200, None), (201, ""), (202, " \n\t"), (203, "y" * 200_000), (204, "{{ a }} " * 20_000)]
    # what is furniture is known by counts only, so pages of other hosts show it
    pages = [(300 + i, f"Login · Register · Help\nThe {w} of the mill grinds wheat in the valley.\n© Example Project", f"host{i}", "clash") for i, w in enumerate("wheel stone miller owner bridge river".split())]
    df = spark.createDataFrame([(i, t, "h" if i % 2 else None, "clash") for i, t in rows] + pages, "doc_id long, text string, source string, id string")
    got = {r[0] for r in residue.residue(df, "doc_id", "text", "source").collect()}
    assert got == set(range(len(RESIDUE))) | {204}
    assert residue.residue(df.limit(0), "doc_id", "text", "source").count() == 0
    twice = residue.residue(df.filter("doc_id = 0").union(df.filter("doc_id = 0")), "doc_id", "text", "source")
    assert [r[0] for r in twice.collect()] == [0, 0]


@pytest.mark.parametrize("notice", ["JavaScriptを有効にしてください。", "请启用JavaScript后重试", "请在浏览器中启用JavaScript。", "JavaScript를 활성화하세요"])
def test_script_notices_without_spaces(notice):
    assert residue.judge_sentence(residue.cleaned(notice)) == "evidence"
    assert residue.judge_sentence("the page will not be saved without a description.") == "content"


def test_furniture_by_host(spark):
    """A line no rule knows is furniture where it recurs, and content elsewhere."""
    rows = [(i, f"A long enough text on the matter number {i} stands here.\nWiki of the mill", "a") for i in range(40)] + [(100, "Wiki of the mill\nError 404: not found", "a"), (101, "Wiki of the mill\nError 404: not found", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r[0] for r in residue.residue(df, "doc_id", "text", "source").collect()] == [100]


def test_counts_decide(spark, monkeypatch):
    """Copies of a page don't make its lines furniture; without the counts most cases are lost."""
    pages = [(i, f"Mill news and views\nThe {w} of the mill grinds wheat in the valley.", f"host{i}") for i, w in enumerate("wheel stone miller owner bridge river".split())]
    cases = [(100 + i, f"Mill news and views\n{t}", "elsewhere") for i, t in enumerate(RESIDUE) if "\n" not in t]
    copies = [(200 + i, "Please enable JavaScript.\nThe harvest of the year was poor in all valleys.", f"host{i}") for i in range(9)]
    df = spark.createDataFrame(pages + cases + copies, "doc_id long, text string, source string")
    assert {r[0] for r in residue.residue(df, "doc_id", "text", "source").collect()} == {x[0] for x in cases}
    assert residue.residue(df, "doc_id", "text", "source", 10**6, 10**6).count() == 0


@pytest.mark.parametrize("sentence", ["The vendor portal you asked for has been moved, please try again later.", "Your ticket list could not be loaded.", "503 service unavailable", "This shop needs JavaScript."])
def test_evidence_is_no_list_of_phrases(sentence):
    assert residue.judge_sentence(residue.cleaned(sentence)) == "evidence"


@pytest.mark.parametrize("sentence", ["The committee could not agree on a budget for the coming year.", "Row 402 of partsupp has no year, so the sum ignores it.", "Title text, name text, fee real,", "The error of the estimate shrinks with the square root of the sample."])
def test_words_of_notices_alone_are_no_evidence(sentence):
    assert residue.judge_sentence(residue.cleaned(sentence)) == "content"


@pytest.mark.parametrize("bound", [residue.MAX_SENT, 0])
def test_many_lines_of_furniture(spark, monkeypatch, bound):
    """Evidence below more than 13 lines of the host's own, and content below them."""
    monkeypatch.setattr(residue, "MAX_SENT", bound)
    own = "\n".join(f"Wiki of the {x}" for x in "mill river bridge tower castle garden forest meadow harbour island valley village market chapel school".split())
    rows = [(i, f"A long enough text on the matter of {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} stands here.\n{own}", "a") for i in range(40)]
    rows += [(100, f"{own}\nError 404: not found", "a"), (101, f"Error 404: not found\n{own}\nThe mill grinds wheat for all of the villages on the river since the spring.", "a"), (102, f"{own}\nError 404: not found", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r[0] for r in residue.residue(df, "doc_id", "text", "source").collect()] == [100]


@pytest.mark.parametrize("line", ["This wiki is kept by volunteers and its pages may be copied freely", "Docs &amp; Guides", "The miller’s wiki"])
def test_furniture_of_any_form(spark, line):
    rows = [(i, f"A long enough text on the matter of {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} stands here.\n{line}", "a") for i in range(40)]
    rows += [(100, f"{line}\nError 404: not found", "a"), (101, f"{line}\nError 404: not found", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r[0] for r in residue.residue(df, "doc_id", "text", "source").collect()] == [100]


def test_subset(spark):
    r = random.Random(4)
    rows = [(i, f"db{i % 5}" if i % 3 else "Hot ", f"SELECT c{r.randrange(6)} FROM t{i % 40} WHERE a = {i}" if i % 3 else f"select x from hot where y = {i}") for i in range(600)]
    rows += [(1000, None, None), (1001, "db1", " "), (None, "db2", "SELECT q FROM z"), (7, "db9", "SELECT other FROM place")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "query_id long, db_id string, query string, kinds string")
    requests = spark.createDataFrame([(1, 10), (2, 40), (3, 0), (4, None), (5, 5000)], "request_id long, subset_size long")
    out = subset.varied_subsets(df, requests, "query_id", "query", "db_id").collect()
    by = {}
    for x in out:
        by.setdefault(x["request_id"], []).append(x["query_id"])
    ids = {x[0] for x in rows if x[0] is not None}
    assert {k: len(v) for k, v in by.items()} == {1: 10, 2: 40, 5: len(ids)} and all(len(set(v)) == len(v) for v in by.values()) and set(by[5]) == ids
    text = {x[0]: x for x in rows}
    hot = sum(text[i][2] is not None and "hot" in text[i][2] for i in by[2])
    assert hot <= 8 and len({text[i][1] for i in by[1]}) >= 5
    assert subset.varied_subsets(df.limit(0), requests, "query_id", "query", "db_id").count() == 0
    assert subset.varied_subsets(df, requests.limit(0), "query_id", "query", "db_id").count() == 0


def test_subset_is_near_greedy(spark):
    """The threshold rounds reach almost the value of the sequential greedy choice."""
    import numpy as np

    r = random.Random(8)
    rows = [(i, f"db{r.randrange(30)}", f"SELECT {', '.join(f'col{r.randrange(60)}' for _ in range(r.randrange(1, 5)))} FROM tab{r.randrange(25)} {r.choice(['', 'ORDER BY 1', 'GROUP BY x', 'LIMIT 3'])}") for i in range(400)]
    df = spark.createDataFrame(rows, "query_id long, db_id string, query string")
    order = subset.selection_order(df, "query_id", "query", "db_id", 30)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows]), pa.array([x[2] for x in rows])], names=["id", "source", "text"])
    kinds = {x["id"]: np.array(x["kinds"]) for b in subset.featured(iter([batch])) for x in b.to_pylist()}

    def value(ids):
        mass = np.zeros(subset.DIMS)
        for i in ids:
            at, w = subset.weighted(kinds[i])
            mass[at] += w
        return np.sqrt(mass).sum()

    mass, greedy = np.zeros(subset.DIMS), []
    for _ in range(30):
        best = max((i for i in kinds if i not in greedy), key=lambda i: subset.gain(mass, *subset.weighted(kinds[i])))
        greedy.append(best)
        at, w = subset.weighted(kinds[best])
        mass[at] += w
    assert len(order) == 30 and value(order) >= 0.9 * value(greedy)
