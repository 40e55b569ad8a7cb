"""Splits that keep related records together.

Records are related by their source (``db_id``) and by a statement held in several sources. Sources are the vertices of
a graph; every statement links the sources that hold it to the least of them (a star, never all pairs). Components
come from :mod:`loomsql.llm.contraction`; components are given to splits by cumulative weight.

Defined results: source names agree but for case and white space around them; records without a source link nothing and
follow a source that holds their statement, else they stay with the other copies of the statement, else alone; null or
blank statements link nothing. Empty tables give empty results. Ties between equal weights fall by name.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .contraction import components, least_of_component
from .copies import _canonical, in_parts, parts_of, staged, trimmed_lower, verify

#: Components heavier than a 1/LARGE share of all records are placed one by one; there are fewer than LARGE of them.
LARGE = 2000
CHECKED = "rep_id bigint, sig bigint, key string, first_key string, class bigint, text string, ok boolean"


def statement_sources(df: DataFrame, id_col: str, text_col: str, source_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One row for each (source, statement) a task met: rep_id, key, class, first_key (the least source that holds it).

    Also the tasks' own copies (rep_id, copy_id).
    """
    reps, edges = staged(df, scratch, id_col, text_col, trimmed_lower(F.col(source_col)))
    # A statement held in very many sources is compared in parts, and the parts' first rows with each other.
    hot = scratch.write(parts_of(reps, ["sig"]), "hot")
    spread = reps.withColumn("part", F.lit(0).cast("bigint")) if hot.isEmpty() else in_parts(reps, hot, ["sig"])
    checked = scratch.write(compared(spread, ["sig", "part"]).mapInArrow(verify, CHECKED), "checked")
    classes = checked.filter("ok").select("rep_id", "key", "first_key", "class")
    if not hot.isEmpty():
        firsts = reps.join(hot, "sig", "left_semi").join(checked.filter("ok and rep_id = class").select("rep_id"), "rep_id")
        again = scratch.write(compared(firsts, ["sig"]).mapInArrow(verify, CHECKED), "firsts").filter("ok")
        whole = again.select(F.col("rep_id").alias("class"), F.col("class").alias("whole"), F.col("first_key").alias("whole_key"))
        classes = classes.join(whole, "class", "left").select("rep_id", "key", F.when(F.col("whole").isNull(), F.col("first_key")).otherwise(F.col("whole_key")).alias("first_key"), F.coalesce("whole", "class").alias("class"))
    collided = checked.filter("not ok")
    if not collided.isEmpty():
        exact = Window.partitionBy("sig", _canonical("text"))
        classes = classes.unionByName(collided.select("rep_id", "key", F.min("key").over(exact).alias("first_key"), F.min("rep_id").over(exact).alias("class")))
    scratch.drop("stage/kind=r")
    return classes, edges


def compared(reps: DataFrame, by: list[str]) -> DataFrame:
    """Every row with the first of its group, to be verified: least source, then least id."""
    w = Window.partitionBy(*by).orderBy(F.col("key").asc_nulls_last(), "rep_id")
    rows = reps.select("rep_id", "sig", "key", "text", F.row_number().over(w).alias("rn"), F.first("key").over(w).alias("first_key"), F.first("rep_id").over(w).alias("class"), F.first("text").over(w).alias("first_text"))
    later = F.col("rn") > 1
    return rows.select("rep_id", "sig", "key", "first_key", "class", F.when(later, F.col("text")).alias("text"), F.when(later, F.col("first_text")).alias("first_text"))


def linked_sources(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(first_source, source) for every source of a linked group but its least name."""
    scratch = Scratch(df.sparkSession, "sources")
    classes, _ = statement_sources(df, id_col, text_col, source_col, scratch)
    labels = components(classes.select(F.col("first_key").alias("u"), F.col("key").alias("v")), scratch)
    return least_of_component(labels).select(F.col("first").alias("first_source"), F.col("vertex").alias("source"))


def place(weights: list[tuple[str, int]], targets: dict[str, float]) -> dict[str, str]:
    """Large components, heaviest first, each to the split that lacks most; then moves and swaps that lessen the total error."""
    lack = dict(targets)
    heap = [(-v, k) for k, v in lack.items()]
    heapq.heapify(heap)
    placed: dict[str, str] = {}
    for name, w in sorted(weights, key=lambda x: (-x[1], x[0])):
        _, split = heap[0]
        placed[name] = split
        lack[split] -= w
        heapq.heapreplace(heap, (-lack[split], split))
    for _ in range(200):  # each step lessens the total error; the number of components is bounded
        over, under = min(lack, key=lambda k: (lack[k], k)), max(lack, key=lambda k: (lack[k], k))
        mine = [(w, n) for n, w in weights if placed[n] == over]
        theirs = [(0, ""), *((w, n) for n, w in weights if placed[n] == under)]
        if not mine or over == under:
            break
        a, b = np.array([w for w, _ in mine], float), np.array([w for w, _ in theirs], float)
        shift = a[:, None] - b[None, :]
        error = abs(lack[over] + shift) + abs(lack[under] - shift)
        i, j = np.unravel_index(int(error.argmin()), error.shape)
        if error[i, j] >= abs(lack[over]) + abs(lack[under]) - 1e-9:
            break
        placed[mine[i][1]] = under
        if theirs[j][1]:
            placed[theirs[j][1]] = over
        lack[over] += shift[i, j]
        lack[under] -= shift[i, j]
    return placed


def split_records(df: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, name_col: str = "split_name", share_col: str = "proportion") -> DataFrame:
    """(id, unit, split_name) for every record; records of one unit are never parted.

    Targets are few rows (shares of one whole) and are read by the driver; null or negative shares count as 0. Without
    any positive share there is no split to name and ``split_name`` is null.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "splits")
    classes, edges = statement_sources(df, id_col, text_col, source_col, scratch)
    labels = components(classes.filter("key is not null").select(F.col("first_key").alias("u"), F.col("key").alias("v")), scratch)
    first = least_of_component(labels).select(F.col("vertex").alias("key"), "first")
    source = trimmed_lower(F.col(source_col))
    records = df.select(F.col(id_col).cast("bigint").alias("id"), source.alias("key"))
    named = records.filter("key is not null").join(first, "key", "left").select("id", F.concat(F.lit("s:"), F.coalesce("first", "key")).alias("unit"))
    # Records without a source: through their task's representative to the least source of the statement, if any.
    loose = classes.filter("key is null").join(first.withColumnRenamed("key", "first_key"), "first_key", "left")
    loose = loose.select("rep_id", F.coalesce(F.concat(F.lit("s:"), F.coalesce("first", "first_key")), F.concat(F.lit("q:"), F.col("class").cast("string"))).alias("unit"))
    copies = loose.join(edges, "rep_id").select(F.col("copy_id").alias("id"), "unit")
    units = loose.select(F.col("rep_id").alias("id"), "unit").unionByName(copies).distinct()
    anonymous = records.filter("key is null").select("id").join(units, "id", "left").select("id", F.coalesce("unit", F.concat(F.lit("r:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))).alias("unit"))
    records = scratch.write(named.unionByName(anonymous), "records")

    shares = {r[0]: max(0.0, float(r[1] or 0)) for r in targets.select(name_col, share_col).collect() if r[0] is not None}
    whole = sum(shares.values())
    if not whole:
        return records.select(F.col("id").alias(id_col), "unit", F.lit(None).cast("string").alias("split_name"))
    weights = scratch.write(records.groupBy("unit").agg(F.count("*").alias("w")), "weights")
    total = weights.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("t")).first()["t"]
    goal = {k: total * v / whole for k, v in shares.items()}
    large = F.col("w") * LARGE > total
    heavy = [(r["unit"], r["w"]) for r in weights.filter(large).collect()]  # fewer than LARGE rows
    placed = place(heavy, goal)
    lack = dict(goal)
    for unit, w in heavy:
        lack[placed[unit]] -= w
    # The rest lies on one line by cumulative weight, cut where the splits are full. Blocks by hash keep the running sum
    # distributed: a window within each block, and the sums of the blocks before it.
    blocks = max(256, int(weights.count() // 100_000))
    rest = weights.filter(~large).withColumn("block", F.pmod(F.xxhash64("unit"), F.lit(blocks)))
    before = rest.groupBy("block").agg(F.sum("w").alias("bw")).select("block", (F.sum("bw").over(Window.orderBy("block")) - F.col("bw")).alias("before"))
    inside = F.sum("w").over(Window.partitionBy("block").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0))
    line = rest.withColumn("inside", inside).join(before, "block").withColumn("mid", F.col("before") + F.col("inside") - F.col("w") / 2)  # one row for each 100,000 units
    open_ = {k: max(0.0, v) for k, v in lack.items()}
    small_total = total - sum(w for _, w in heavy)
    scale = small_total / sum(open_.values()) if sum(open_.values()) else 0.0
    at, split = 0.0, F.lit(max(goal, key=lambda k: (goal[k], k)))
    names = sorted(open_, key=lambda k: (-open_[k], k))
    if scale:
        split = F.lit(names[-1])
        cuts = []
        for k in names:
            at += open_[k] * scale
            cuts.append((k, at))
        last = [k for k, _ in cuts if open_[k] > 0][-1]
        split = F.lit(last)
        for k, end in reversed(cuts[: names.index(last)]):
            split = F.when(F.col("mid") <= end, F.lit(k)).otherwise(split)
    small = line.select("unit", split.alias("split_name"))
    big = spark.createDataFrame([(u, s) for u, s in placed.items()] or [("", "")], "unit string, split_name string").filter("unit <> ''")
    return records.join(small.unionByName(big), "unit", "left").select(F.col("id").alias(id_col), "unit", "split_name")


def p3_found(spark, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/spider_query.parquet")
    return linked_sources(df, "query_id", "query", "db_id").select(F.col("first_source").alias("first_db_id"), F.col("source").alias("db_id"))


def p3_parted(spark, sf_dir: str) -> DataFrame:
    """(parted): how many databases have records in more than one split."""
    names = spark.read.parquet(f"{sf_dir}/spider_query.parquet").select("query_id", trimmed_lower(F.col("db_id")).alias("db")).filter("db is not null")
    held = p3_splits(spark, sf_dir).join(names, "query_id").groupBy("db").agg(F.min("split_name").alias("a"), F.max("split_name").alias("b"))
    return held.agg(F.count(F.when(F.col("a") != F.col("b"), True)).alias("parted"))


def p3_splits(spark, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/spider_query.parquet")
    targets = spark.read.parquet(f"{sf_dir}/split_target.parquet")
    return split_records(df, targets, "query_id", "query", "db_id").select("query_id", "split_name")
