"""Queries about queries: generation, recognition, training, cardinality."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialect import ast as A
from ..dialect import render_duckdb, training
from ..dialect.binder import Binder
from ..dialect.constraint import range_reward
from ..dialect.engine import KEYS, Engine
from ..dialect.equivalence import logics_agree
from ..dialect.generator import generate
from ..dialect.parser import SyntaxProblem, parse
from ..dialect.schema import parse_ddl, relation_of
from ..session import table
from .registry import query

STAR = ("region", "nation", "customer", "supplier", "part", "orders")


def star_schema(spark: SparkSession, sf_dir: str) -> dict:
    return {n: relation_of(n, table(spark, sf_dir, n).schema, KEYS.get(n, ())) for n in STAR}


@query("generate_queries")
def generate_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.bulk_generate(spark, star_schema(spark, sf_dir), 1000, stir=6, partitions=8)


#: Tables of generated queries that are run, with the types the driver's files have.
SMALL = parse_ddl("""
    CREATE TABLE region (r_regionkey int, r_name text);
    CREATE TABLE nation (n_nationkey int, n_name text, n_regionkey int);
    CREATE TABLE supplier (s_suppkey bigint, s_name text, s_nationkey int, s_acctbal double precision);
""")
RUN_SEEDS = range(400)


def run_texts() -> dict[int, tuple[A.Query, str]]:
    """By seed: generated queries of few tables, and the same for DuckDB where it defines all their parts alike."""
    out = {}
    for seed in RUN_SEEDS:
        q, _ = generate(SMALL, seed, 3)
        if any(isinstance(n, A.Query) and n.limit for n in q.walk()) or sum(isinstance(n, A.Table) for n in q.walk()) > 3:
            continue
        binder = Binder(SMALL)
        bound = binder.query(q)
        if any(t == "interval" for _, t in bound.columns):
            continue
        try:
            text = render_duckdb.query(bound.query, binder)
        except render_duckdb.Unfit:
            continue
        if "trunc_div" not in text and "/" not in text and "^" not in text and "pow(" not in text:
            out[seed] = q, text
    return out


def run_sql() -> str:
    return " UNION ALL ".join(f"SELECT {seed} AS seed, count(*) AS n FROM ({text}) AS q{seed}" for seed, (_, text) in sorted(run_texts().items()))


@query("generate_and_run", run_sql)
def generate_and_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of generated queries, run over the tables they name, by seed."""
    engine = Engine(spark, {n: table(spark, sf_dir, n) for n in SMALL})
    parts = [engine.sql(q).agg(F.count("*").alias("n")).select(F.lit(seed).alias("seed"), "n") for seed, (q, _) in sorted(run_texts().items())]
    return reduce(DataFrame.unionByName, parts)


@query("path_roundtrip", "SELECT 'same' AS outcome, CAST(500 AS BIGINT) AS n")
def path_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognising a query and replaying its path gives it back, for each of 500."""
    schema = star_schema(spark, sf_dir)
    corpus = training.bulk_generate(spark, schema, 500, stir=5, partitions=8)
    return training.round_trips(corpus, "sql", schema).groupBy("outcome").agg(F.count("*").alias("n"))


@query("bulk_validity", "SELECT 'valid' AS outcome, CAST(1000 AS BIGINT) AS n")
def bulk_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of reading and binding the text of 1,000 generated queries at stir 11, with classes of errors."""
    schema = star_schema(spark, sf_dir)
    return training.validity(training.bulk_generate(spark, schema, 1000, stir=11, partitions=32), "sql", schema).groupBy("outcome").agg(F.count("*").alias("n"))


@query("generator_constructs")
def generator_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many of 10,000 generated queries each option of the grammar is taken."""
    return training.constructs(spark, star_schema(spark, sf_dir), 10_000, stir=6, partitions=16)


@query("corpus_recognition")
def corpus_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of the corpus by what becomes of them under the schema of their database."""
    schemas = table(spark, sf_dir, "spider_database").select("db_id", "schema_sql")
    rows = table(spark, sf_dir, "spider_query").filter("query is not null").select(F.lower(F.trim("db_id")).alias("db_id"), "query")
    return training.coverage(rows.join(schemas, "db_id", "left").select("schema_sql", "query")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("markov_train")
def markov_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = star_schema(spark, sf_dir)
    return training.transitions(training.bulk_generate(spark, schema, 500, stir=5, partitions=8), "sql", schema, "caller")


@query("markov_generate")
def markov_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by weights learnt from a corpus."""
    schema = star_schema(spark, sf_dir)
    learnt = training.Model.of(training.transitions(training.bulk_generate(spark, schema, 300, stir=5, partitions=8), "sql", schema))
    return training.bulk_generate(spark, schema, 500, stir=6, model=learnt, seed=10_000, partitions=8)


@query(
    "cardinality_reward",
    """
    WITH c AS (
      SELECT 'SELECT * FROM nation' AS query, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'SELECT * FROM region', (SELECT count(*) FROM region)
      UNION ALL SELECT 'SELECT * FROM nation, region', (SELECT count(*) FROM nation, region)
      UNION ALL SELECT 'SELECT c_custkey FROM customer WHERE c_acctbal > 9000', (SELECT count(*) FROM customer WHERE c_acctbal > 9000))
    SELECT query, n, CASE WHEN n BETWEEN 20 AND 30 THEN 5.0 ELSE greatest(-greatest(abs(n - 20) / 20.0, abs(n - 30) / 30.0), -5.0) END::DOUBLE AS reward FROM c
    """,
)
def cardinality_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of a few queries and their reward for lying in [20, 30]."""
    texts = ["SELECT * FROM nation", "SELECT * FROM region", "SELECT * FROM nation, region", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000"]
    counts = [(t, Engine.over(spark, sf_dir, t).sql(t).count()) for t in texts]
    return spark.createDataFrame([(t, n, range_reward(n, 20, 30)) for t, n in counts], "query string, n bigint, reward double")


@query("logics_agree")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the corpus' statements, how many the dialect reads, and in how many both logics agree."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                try:
                    out.append(str(logics_agree(parse(text))).lower())
                except SyntaxProblem:
                    out.append("not read")
                except ValueError:
                    out.append("not plain")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["outcome"])

    rows = table(spark, sf_dir, "spider_query").filter("query is not null").select("query").mapInArrow(run, "outcome string")
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "query_log_errors",
    """
    SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 4) AS percent FROM events GROUP BY event_type
    """,
)
def query_log_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of outcomes in a log with their shares, the way failed runs are summed up."""
    log = table(spark, sf_dir, "events")
    total = log.agg(F.count("*").alias("total"))
    return log.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("event_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))
