"""Sources of queries and schemas: SQL files, database collections in JSON, DDL files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialect.binder import Relation
from ..dialect.schema import parse_ddl


def sql_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text): the statements of SQL files, cut at semicolons. Comment lines and blanks fall away."""
    rows = spark.read.text(path, lineSep=";").select(F.regexp_replace(F.regexp_replace("value", r"(?m)^\s*--[^\n]*$", ""), r"^\s+|\s+$", "").alias("text"))
    return rows.filter(r"text rlike '\\S'")


def question_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(db_id, query, question) of a JSON array of records."""
    return spark.read.schema("db_id string, query string, question string").json(path, multiLine=True)


def database_schemas(spark: SparkSession, path: str) -> DataFrame:
    """(db_id, table_names, column_names, column_types, primary_keys) of a JSON array of database descriptions."""
    return spark.read.schema(
        "db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_types array<string>, primary_keys array<int>"
    ).json(path, multiLine=True)


def ddl_schema(spark: SparkSession, path: str) -> dict[str, Relation]:
    """Tables of the CREATE TABLE statements in a file; a schema is small by nature."""
    return parse_ddl("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def sample_values(df: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """(value): n rows' values in random order, to serve as literals."""
    return df.select(F.col(column).alias("value")).orderBy(F.rand(seed)).limit(n)
