"""Sinks: queries as SQL text, learnt weights as tables or as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sql(df: DataFrame, column: str, path: str) -> None:
    """One statement a line, ended by a semicolon."""
    df.select(F.concat(F.regexp_replace(column, r"\s+", " "), F.lit(";")).alias("value")).write.mode("overwrite").text(path)


def write_weights(weights: DataFrame, path: str) -> None:
    weights.write.mode("overwrite").parquet(path)


def weights_graph(weights: DataFrame, limit: int = 10_000) -> str:
    """The heaviest edges of a model in the DOT language."""
    rows = weights.orderBy(F.desc("n"), "ctx", "before", "option").limit(limit).collect()
    lines = [f'  "{r["ctx"]}: {r["before"]}" -> "{r["ctx"]}: {r["option"]}" [label="{r["weight"]:.3f}"];' for r in rows]
    return "\n".join(["digraph weights {", *lines, "}"])
