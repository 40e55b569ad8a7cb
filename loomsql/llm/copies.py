"""Duplicates hidden by formatting differences.

``collapse`` finds classes of statements that agree but for layout (see :mod:`loomsql.llm.statements`), within one key.

Plan: each task hashes its rows batch by batch and merges copies it can see itself, after comparing them byte by byte.
What leaves a task is one row with text for each class it met (R) and bare id pairs for the rest (E), so a class that
holds a third of all rows sends one text a task, or one text a slice once the task's memory of texts is full. R is shuffled
once by signature; every row is compared with the first of its group. A group of more than ``HOT`` rows (counted first) is
compared in parts of about that size, and the parts' first rows with each other. E meets the outcome in a join on the task's
own representative, whose rows never exceed one task's input. Rows whose comparison fails (hash collisions) are grouped by
exact canonical form instead.

Defined results: null or blank texts belong to no class; a null key agrees with null only; repeated ids count as copies
of themselves and yield no row; an empty table yields no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..session import Scratch
from .statements import Profile, canonical, sliced

#: Bytes of text that one task keeps to recognise copies across its batches; beyond it the shuffle finds them.
KEEP_BYTES = 16 << 20
#: A group of more rows than this is compared in parts.
HOT = 50_000
CHECKED = "rep_id bigint, min_id bigint, sig bigint, key string, kept_id bigint, head bigint, text string, ok boolean"
STAGE = "kind string, rep_id bigint, copy_id bigint, min_id bigint, sig bigint, key string, text string"
_ARROW = pa.schema([("kind", pa.string()), ("rep_id", pa.int64()), ("copy_id", pa.int64()), ("min_id", pa.int64()), ("sig", pa.int64()), ("key", pa.string()), ("text", pa.string())])


def trimmed_lower(c: Column) -> Column:
    """Lower case without white space (of any script) around it."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def local_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text) -> R rows (kind r) and E rows (kind e) of one task."""
    kept: dict[tuple, list] = {}  # (sig, key) -> [rep id, least id, text]
    size = 0
    for batch in sliced(batches, 2):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        keys = batch.column(1)
        texts = batch.column(2)
        prof = Profile(texts)
        code = keys.dictionary_encode()
        key_code = np.asarray(code.indices.fill_null(-1))
        key_names = [*code.dictionary.to_pylist(), None]
        live = np.flatnonzero(~prof.blank)
        order = live[np.lexsort((ids[live], key_code[live], prof.signature[live]))]
        if not len(order):
            continue
        sig, kc = prof.signature[order], key_code[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (kc[1:] != kc[:-1])])
        heads = order[np.flatnonzero(new)]
        group = np.cumsum(new) - 1
        known = [kept.get((int(prof.signature[h]), key_names[key_code[h]])) for h in heads]
        rep_row = np.where(np.array([k is not None for k in known]), -1, heads)[group]  # -1: the text kept from earlier
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        alone = [order[np.flatnonzero(new & (rep_row >= 0))]]
        mine = np.flatnonzero((rep_row >= 0) & ~new)
        if len(mine):
            ok = prof.equal(order[mine], prof, rep_row[mine])
            edges.append((ids[rep_row[mine[ok]]], ids[order[mine[ok]]]))
            alone.append(order[mine[~ok]])
        old = np.flatnonzero(rep_row < 0)
        if len(old):
            used = np.unique(group[old])
            before = Profile(pa.array([known[g][2] for g in used], pa.large_string()))
            ok = prof.equal(order[old], before, np.searchsorted(used, group[old]))
            reps = np.array([known[g][0] for g in used], np.int64)[np.searchsorted(used, group[old[ok]])]
            edges.append((reps, ids[order[old[ok]]]))
            alone.append(order[old[~ok]])
            for g, i in zip(group[old[ok]], ids[order[old[ok]]]):
                known[g][1] = min(known[g][1], int(i))
        out = np.concatenate(alone)
        first = set(heads.tolist())
        now = []
        for i, t in zip(out.tolist(), texts.take(pa.array(out)).to_pylist()):
            where = (int(prof.signature[i]), key_names[key_code[i]])
            if i in first and where not in kept and size < KEEP_BYTES:
                kept[where] = [int(ids[i]), int(ids[i]), t]
                size += len(t) + 200
            else:
                now.append((int(ids[i]), int(prof.signature[i]), where[1], t))
        if now:
            yield _reps([x[0] for x in now], [x[0] for x in now], [x[1] for x in now], [x[2] for x in now], [x[3] for x in now])
        for reps, copies in edges:
            keep = reps != copies
            if keep.any():
                n = int(keep.sum())
                none = lambda t: pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays([pa.array(["e"] * n), pa.array(reps[keep]), pa.array(copies[keep]), none(pa.int64()), none(pa.int64()), none(pa.string()), none(pa.string())], schema=_ARROW)
    rows = list(kept.items())
    for k in range(0, len(rows), 10_000):
        part = rows[k : k + 10_000]
        yield _reps([v[0] for _, v in part], [v[1] for _, v in part], [w[0] for w, _ in part], [w[1] for w, _ in part], [v[2] for _, v in part])


def _reps(rep: list, least: list, sig: list, key: list, text: list) -> pa.RecordBatch:
    n = len(rep)
    return pa.RecordBatch.from_arrays([pa.array(["r"] * n), pa.array(rep, pa.int64()), pa.nulls(n, pa.int64()), pa.array(least, pa.int64()), pa.array(sig, pa.int64()), pa.array(key, pa.string()), pa.array(text, pa.string())], schema=_ARROW)


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``ok``: whether ``text`` and ``first_text`` (null: nothing to compare) agree; drops texts that did."""
    for batch in (part for whole in batches for part in sliced(iter([whole]), whole.schema.names.index("text"))):
        names = batch.schema.names
        a, b = batch.column(names.index("text")), batch.column(names.index("first_text"))
        ok = np.ones(len(a), bool)
        rows = np.flatnonzero(np.asarray(b.is_valid()))
        if len(rows):
            at = np.arange(len(rows))
            ok[rows] = Profile(a.take(pa.array(rows))).equal(at, Profile(b.take(pa.array(rows))), at)
        text = pa.array([None if good else t for good, t in zip(ok, a.to_pylist())], pa.string()) if not ok.all() else pa.nulls(len(a), pa.string())
        cols = [text if n == "text" else batch.column(i) for i, n in enumerate(names) if n != "first_text"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(ok)], names=[*(n for n in names if n != "first_text"), "ok"])


@F.udf(BinaryType())
def _canonical(text: str) -> bytes:
    return canonical(text)


def staged(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, key: Column | None) -> tuple[DataFrame, DataFrame]:
    """R and E of all tasks, written once."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), (key if key is not None else F.lit(None)).cast("string").alias("key"), F.col(text_col).alias("text"))
    rows = rows.filter("id is not null and text is not null")
    stage = scratch.write(rows.mapInArrow(local_classes, STAGE), "stage", partition_by="kind")
    return stage.filter("kind = 'r'").drop("kind", "copy_id"), stage.filter("kind = 'e'").select("rep_id", "copy_id")


def parts_of(reps: DataFrame, by: list[str]) -> DataFrame:
    """(by, parts) of every group of more than ``HOT`` rows."""
    return reps.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select(*by, F.ceil(F.col("n") / HOT).alias("parts"))


def in_parts(reps: DataFrame, hot: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """The rows with ``part``, spread over the parts of their group."""
    other = hot.select(*(F.col(c).alias(f"hot_{c}") for c in by), "parts")
    joined = reps.join(other, [F.col(c).eqNullSafe(F.col(f"hot_{c}")) for c in by], how)
    return joined.withColumn("part", F.pmod(F.xxhash64("rep_id"), F.coalesce("parts", F.lit(1)))).select(*reps.columns, "part")


def compared(reps: DataFrame, by: list[str]) -> DataFrame:
    """Every row with the first of its group (``head``), to be verified."""
    w = Window.partitionBy(*by).orderBy("min_id", "rep_id")
    rows = reps.select("rep_id", "min_id", "sig", "key", "text", F.first("min_id").over(w).alias("kept_id"), F.first("rep_id").over(w).alias("head"), F.row_number().over(w).alias("rn"), F.first("text").over(w).alias("first_text"))
    later = F.col("rn") > 1
    return rows.select("rep_id", "min_id", "sig", "key", "kept_id", "head", F.when(later, F.col("text")).alias("text"), F.when(later, F.col("first_text")).alias("first_text"))


def collapse(df: DataFrame, id_col: str, text_col: str, key: Column | None = None) -> DataFrame:
    """(kept_id, copy_id) for every row of a class but its least id, which is ``kept_id``. See the module's text."""
    scratch = Scratch(df.sparkSession, "copies")
    reps, edges = staged(df, scratch, id_col, text_col, key)
    hot = scratch.write(parts_of(reps, ["sig", "key"]), "hot")
    few = hot.isEmpty()
    spread = reps.withColumn("part", F.lit(0).cast("bigint")) if few else in_parts(reps, hot, ["sig", "key"])
    checked = scratch.write(compared(spread, ["sig", "key", "part"]).mapInArrow(verify, CHECKED), "checked")
    classes = checked.filter("ok").select("rep_id", "kept_id", "head")
    if not few:
        heads = checked.filter("ok and rep_id = head").select("rep_id")
        firsts = in_parts(reps, hot, ["sig", "key"], "inner").join(heads, "rep_id")
        again = scratch.write(compared(firsts, ["sig", "key"]).mapInArrow(verify, CHECKED), "firsts").filter("ok")
        classes = classes.join(again.select(F.col("rep_id").alias("head"), F.col("kept_id").alias("whole")), "head", "left").select("rep_id", F.coalesce("whole", "kept_id").alias("kept_id"))
    classes = classes.select("rep_id", "kept_id")
    scratch.drop("stage/kind=r")
    collided = checked.filter("not ok")
    if not collided.isEmpty():
        exact = Window.partitionBy("sig", "key", _canonical("text"))
        classes = classes.unionByName(collided.select("rep_id", F.min("min_id").over(exact).alias("kept_id")))
    members = classes.select("kept_id", F.col("rep_id").alias("copy_id")).unionByName(classes.join(edges, "rep_id").select("kept_id", "copy_id"))
    return members.filter("copy_id <> kept_id")


def copy_counts(df: DataFrame, id_col: str, text_col: str, key: Column | None = None) -> DataFrame:
    """One row for each distinct statement: its least id and the number of records it stands for."""
    pairs = collapse(df, id_col, text_col, key)
    live = df.filter(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"(?U)\S")).select(F.col(id_col).cast("bigint").alias("record_id"))
    return (
        live.join(pairs.withColumnRenamed("copy_id", "record_id"), "record_id", "left")
        .groupBy(F.coalesce("kept_id", "record_id").alias("kept_id"))
        .agg(F.count("*").alias("n_records"))
    )


def p2_found(spark, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/spider_query.parquet")
    return collapse(df, "query_id", "query", trimmed_lower(F.col("db_id")))


def p2_counts(spark, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/spider_query.parquet")
    return copy_counts(df, "query_id", "query", trimmed_lower(F.col("db_id")))
