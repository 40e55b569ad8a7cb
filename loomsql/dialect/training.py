"""Generation weights learnt from a corpus of queries, as one Spark aggregation; generation in bulk.

Queries are recognised in the tasks; what leaves them are decisions counted by (function, context, option before,
option). Contexts are the seven kinds below: the function, the function with its parameters and open gates (full), each also
stacked and by depth, and the function with its caller. Counts are normalised over a window by context. The model is as large as the grammar allows
for its kind of context, not as the corpus; kinds with stacks may be large and are bounded when they are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import render_pg
from .binder import Binder, BindProblem, Relation
from .generator import Call, Chooser, NotRecognised, generate, recognise
from .grammar import GRAMMAR
from .parser import SyntaxProblem, parse
from .schema import parse_ddl

KINDS = ("function", "stacked functions", "function by depth", "full", "stacked full", "full by depth", "caller")
MAX_MODEL = 2_000_000


def context(kind: str, stack: list[str]) -> str:
    """The context of a decision in the function on top of a stack."""
    top, depth = stack[-1], len(stack)
    if kind == "function":
        return top
    if kind == "stacked functions":
        return "/".join(stack)
    if kind == "function by depth":
        return f"{top}@{depth}"
    if kind == "full":
        return _full(top)
    if kind == "stacked full":
        return "/".join(map(_full, stack))
    if kind == "full by depth":
        return f"{_full(top)}@{depth}"
    if kind == "caller":
        return "/".join(stack[-2:])
    raise ValueError(kind)


def _full(call: str) -> str:
    """A function with the parameters it was called with and the gates open to it."""
    return f"{call}({getattr(call, 'detail', '').strip()})"


def _decisions(schema: dict[str, Relation], kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                try:
                    _, path = recognise(schema, parse(text))
                except (SyntaxProblem, BindProblem, NotRecognised, RecursionError):
                    seen["", "", "unrecognised"] += 1
                    continue
                stack: list[str] = []
                before: list[str] = []
                for step in path:
                    if step[0] == "call":
                        stack.append(Call(step[1], step[2]))
                        before.append("entry")
                    elif step[0] == "exit":
                        stack.pop()
                        before.pop()
                    elif step[0] == "option":
                        seen[context(kind, stack), before[-1], step[2]] += 1
                        before[-1] = step[2]
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([seen[k] for k in keys], pa.int64())], names=["ctx", "before", "option", "n"])

    return run


def transitions(corpus: DataFrame, text_col: str, schema: dict[str, Relation], kind: str = "function") -> DataFrame:
    """(ctx, before, option, n, weight): weights of one (ctx, before) sum to 1. Queries the grammar can't make are left out."""
    rows = corpus.select(F.col(text_col).alias("text")).filter("text is not null")
    counts = rows.mapInArrow(_decisions(schema, kind), "ctx string, before string, option string, n bigint").filter("ctx <> ''")
    counts = counts.groupBy("ctx", "before", "option").agg(F.sum("n").alias("n"))
    return counts.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("ctx", "before")))


def unrecognised(corpus: DataFrame, text_col: str, schema: dict[str, Relation]) -> DataFrame:
    """(n): how many queries the grammar can't make."""
    rows = corpus.select(F.col(text_col).alias("text")).filter("text is not null")
    counts = rows.mapInArrow(_decisions(schema, "function"), "ctx string, before string, option string, n bigint")
    return counts.filter("ctx = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


class Model:
    """Learnt weights of decisions; where nothing was learnt all options weigh alike."""

    def __init__(self, weights: dict[tuple[str, str], dict[str, float]], kind: str = "function"):
        self.learnt = weights
        self.kind = kind

    @classmethod
    def of(cls, table: DataFrame, kind: str = "function") -> "Model":
        rows = table.select("ctx", "before", "option", "weight").limit(MAX_MODEL + 1).collect()
        if len(rows) > MAX_MODEL:
            raise ValueError(f"the model has more than {MAX_MODEL} weights; choose a coarser context")
        out: dict[tuple[str, str], dict[str, float]] = defaultdict(dict)
        for r in rows:
            out[r["ctx"], r["before"]][r["option"]] = r["weight"]
        return cls(dict(out), kind)

    def weights(self, stack: list[str], before: str, options: list[str]) -> list[float]:
        known = self.learnt.get((context(self.kind, stack), before), {})
        w = [known.get(o, 0.0) for o in options]
        return w if any(w) else [1.0] * len(options)


def bulk_generate(spark: SparkSession, schema: dict[str, Relation], n: int, stir: int = 6, model: Model | None = None, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(query_no, sql, n_nodes): n seeded queries, made in the tasks; the same whatever the partitioning."""
    weights = model.weights if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = [generate(schema, seed + i, stir, weights)[0] for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([render_pg.query(q) for q in made], pa.string()), pa.array([q.count() for q in made], pa.int32())], names=["query_no", "sql", "n_nodes"])

    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return ids.mapInArrow(run, "query_no bigint, sql string, n_nodes int")


def round_trips(corpus: DataFrame, text_col: str, schema: dict[str, Relation]) -> DataFrame:
    """(text, outcome): 'same' if recognising and replaying a query gives it back, else what went wrong."""
    from .generator import replay

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                try:
                    bound, path = recognise(schema, parse(text))
                    out.append("same" if replay(schema, path) == bound else "different")
                except (SyntaxProblem, BindProblem, NotRecognised) as e:
                    out.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["text", "outcome"])

    return corpus.select(F.col(text_col).alias("text")).filter("text is not null").mapInArrow(run, "text string, outcome string")


def _outcomes(judge):
    """One outcome a row, from all its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judge(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["outcome"])

    return run


def _class(e: Exception) -> str:
    """An error without the names and values in it."""
    return f"{type(e).__name__}: " + " ".join([w for w in str(e).split() if w.isalpha()][:4])


def validity(corpus: DataFrame, text_col: str, schema: dict[str, Relation]) -> DataFrame:
    """(outcome) of each query: 'valid', or the class of the error that reading or binding it gives."""

    def judge(text: str) -> str:
        try:
            Binder(schema).query(parse(text))
            return "valid"
        except (SyntaxProblem, BindProblem, RecursionError) as e:
            return _class(e)

    return corpus.select(text_col).filter(F.col(text_col).isNotNull()).mapInArrow(_outcomes(judge), "outcome string")


def coverage(corpus: DataFrame) -> DataFrame:
    """(schema text, query text) -> (outcome): 'recognised', else the first step that fails and why."""
    known: dict[str, dict] = {}

    def judge(ddl: str | None, text: str) -> str:
        if not ddl:
            return "no schema"
        if ddl not in known:
            if len(known) > 10_000:
                known.clear()
            try:
                known[ddl] = parse_ddl(ddl)
            except (SyntaxProblem, ValueError, IndexError):
                known[ddl] = {}
        try:
            recognise(known[ddl], parse(text))
            return "recognised"
        except (SyntaxProblem, BindProblem, NotRecognised) as e:
            return _class(e)
        except (KeyError, AttributeError, TypeError, IndexError, RecursionError) as e:
            return f"not recognised: {type(e).__name__}"

    return corpus.mapInArrow(_outcomes(judge), "outcome string")


def constructs(spark: SparkSession, schema: dict[str, Relation], n: int, stir: int, partitions: int | None = None) -> DataFrame:
    """(function, option, n): in how many of n generated queries an option is taken; options never taken have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter({(f, o): 0 for f, options in GRAMMAR.items() for o in options})
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                seen.update({(calls[-1], o) for calls, o in _taken(generate(schema, seed, stir)[1])})
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], names=["function", "option", "n"])

    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return ids.mapInArrow(run, "function string, option string, n bigint").groupBy("function", "option").agg(F.sum("n").alias("n"))


def _taken(path: list) -> Iterator[tuple[list[str], str]]:
    """(stack of calls, option) of every decision of a path."""
    stack: list[str] = []
    for step in path:
        if step[0] == "call":
            stack.append(step[1])
        elif step[0] == "exit":
            stack.pop()
        elif step[0] == "option":
            yield stack, step[2]


class AskingChooser(Chooser):
    """Puts every decision to somebody who answers in words (a person, a language model); asks again after a wrong answer."""

    def __init__(self, ask, retries: int = 3):
        self.ask = ask
        self.retries = retries

    def option(self, stack: list[str], before: str, options: list[str]) -> str:
        if len(options) == 1:
            return options[0]
        question = f"In {' > '.join(stack[-3:])}, after {before}: which of {', '.join(options)}?"
        for _ in range(self.retries):
            answer = str(self.ask(question)).strip()
            if answer in options:
                return answer
            question = f"{answer!r} is none of {', '.join(options)}. Which one?"
        raise NotRecognised(f"no usable answer in {self.retries} tries")

    def value(self, what: str, options: list):
        return options[0]

    def number(self, low: int, high: int) -> int:
        return low
