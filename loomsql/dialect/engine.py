"""Runs text of the dialect on Spark: parse, bind, rewrite to Spark SQL, and leave the rest to Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import ast as A
from .binder import Binder, Bound, Relation
from .parser import parse, parse_view
from .render_spark import Renderer
from .rewrite import shallow
from .schema import relation_of

#: Keys of the tables that have one; lineitem has none.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "events": ("event_id",), "track": ("track_id",), "spider_query": ("query_id",), "spider_database": ("db_id",), "documents": ("doc_id",),
}


class Engine:
    """A set of named tables and the dialect over them."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]] | None = None):
        self.spark = spark
        self.tables = tables
        self.schema: dict[str, Relation] = {n: relation_of(n, df.schema, (keys or {}).get(n, ())) for n, df in tables.items()}

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, text: str) -> "Engine":
        """An engine over the tables of a folder that a text names."""
        from ..session import TABLES

        words = set(re.findall(r"\w+", text.lower()))  # quoted names too
        return cls(spark, {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in TABLES if n in words}, KEYS)

    def bind(self, q: A.Query | str) -> tuple[Binder, Bound]:
        binder = Binder(self.schema)
        return binder, binder.query(parse(q) if isinstance(q, str) else q)

    def to_spark(self, q: A.Query | str) -> str:
        binder, bound = self.bind(q)
        flat = shallow(bound.query)
        if flat != bound.query:
            binder, bound = self.bind(flat)
        return Renderer(binder).query(self.settled(bound.query, binder))

    def settled(self, q: A.Query, binder: Binder) -> A.Query:
        """R20: a LIMIT that asks a subquery is a number before the query is planned."""
        if q.limit is None or not any(isinstance(n, A.Query) for n in q.limit.walk()):
            return q
        value = self.spark.sql(f"SELECT {Renderer(binder).expr(q.limit)}").first()[0]
        return A.Query(q.body, q.order_by, None if value is None else A.Literal("int", str(round(value))), q.offset, q.ctes)

    def sql(self, q: A.Query | str) -> DataFrame:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(self.to_spark(q))

    def create_view(self, text: str) -> DataFrame:
        """Runs CREATE VIEW: the query becomes one of the engine's tables."""
        found = parse_view(text)
        if found is None:
            raise ValueError("CREATE VIEW expected")
        name, columns, q = found
        df = self.sql(q)
        if len(columns) > len(df.columns):
            raise ValueError(f"{name} has {len(df.columns)} columns, not {len(columns)}")
        df = df.toDF(*columns, *df.columns[len(columns) :])
        self.tables[name] = df
        self.schema[name] = relation_of(name, df.schema)
        return df


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return Engine.over(spark, sf_dir, text).sql(text)
