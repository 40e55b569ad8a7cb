"""Connected components by random-mate contraction, in SQL joins.

Each round every vertex throws a coin (a hash of its name and the round). A vertex that threw tails and has neighbours
that threw heads moves into the least of those; both ends of every edge are renamed, loops and repeats fall away. A
constant share of the vertices with edges leaves each round, so about log(n) rounds empty the edge table. The moves of
all rounds form a forest of height at most the number of rounds, unwound by pointer doubling.

Hot vertices are no trouble: the moves are found by an aggregation with a map-side part, and the renaming joins have
one row a vertex on the other side, where adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

MAX_ROUNDS = 400


def _coin(c: str, rnd: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(c), F.lit(rnd)), F.lit(2)) == 1


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u, v) of any one type -> (vertex, root) for every vertex with an edge; root is one vertex of its component.

    Loops, repeats and nulls are disregarded; an empty table gives an empty result.
    """
    norm = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    current = scratch.write(norm, "edges0")
    kind = current.schema["u"].dataType
    rounds = 0
    while not current.isEmpty():
        if rounds == MAX_ROUNDS:
            raise RuntimeError(f"edges left after {MAX_ROUNDS} rounds")
        tails = F.when(_coin("u", rounds), F.col("v")).otherwise(F.col("u"))
        heads = F.when(_coin("u", rounds), F.col("u")).otherwise(F.col("v"))
        moves = current.filter(_coin("u", rounds) != _coin("v", rounds)).groupBy(tails.alias("vertex")).agg(F.min(heads).alias("parent"))
        moves = scratch.write(moves, f"moves/round={rounds}")
        a = moves.select(F.col("vertex").alias("u"), F.col("parent").alias("pu"))
        b = moves.select(F.col("vertex").alias("v"), F.col("parent").alias("pv"))
        renamed = current.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v"))
        renamed = renamed.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        current = scratch.write(renamed, f"edges{rounds + 1}")
        scratch.drop(f"edges{rounds}")
        rounds += 1
    spark = edges.sparkSession
    if not rounds:
        return spark.createDataFrame([], f"vertex {kind.simpleString()}, root {kind.simpleString()}")
    forest = spark.read.schema(moves.schema).parquet(*[scratch.path(f"moves/round={r}") for r in range(rounds)])
    height = 1
    while height < rounds:  # each doubling halves the height
        up = forest.select(F.col("vertex").alias("parent"), F.col("parent").alias("above"))
        forest = scratch.write(forest.join(up, "parent", "left").select("vertex", F.coalesce("above", "parent").alias("parent")), f"forest{height}")
        height *= 2
    up = forest.select(F.col("vertex"), F.col("parent").alias("root"))
    return up.unionByName(up.select(F.col("root").alias("vertex"), "root").distinct())


def least_of_component(labels: DataFrame, value: str = "vertex") -> DataFrame:
    """(vertex, root) -> (first, vertex) for every vertex but the least of its component."""
    least = labels.groupBy("root").agg(F.min(value).alias("first"))
    return labels.join(least, "root").filter(F.col("first") != F.col("vertex")).select("first", "vertex")
