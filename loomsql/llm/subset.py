"""A varied subset of given size by concave feature coverage.

A record has four kinds of features: its source, the skeleton of its statement (clause and function words in order), the
words of that skeleton, and the names the statement uses. A subset's value is the sum over features of the square root
of the mass its members put on the feature, so a second record of a kind gains less than the first one. Mass is scaled
so that each kind is worth at most 1 for one record, however long: n features of a kind have mass 1 / n^2 each.

Rounds of descending thresholds: each round sends the mass of the subset so far to the tasks (at most ``DIMS`` numbers,
whatever the size of the data); each task walks over its records and picks those whose gain, given the subset and its own picks
so far, reaches the threshold, at most as many as are wanted still; the driver takes at most ``4 x wanted`` picks, in
order of a hash of their ids, and keeps those that still reach the threshold. A threshold is done when a round keeps all
picks there were. The order of selection serves every size: the first k records are the subset of size k.

A gain never rises, so each record keeps its last known gain as a bound: a round reads only records whose bound reaches its
threshold (the bound is a sorted column of the table, pushed down to the scan). Whenever the threshold has halved the table
is written anew with the gains of that moment and without the records chosen so far.

Thresholds end at ``LEAST``: a record that adds less than a hundredth of what the first one can add covers nothing new, and
what is still wanted then is filled in order of a hash of the ids, which favours no group.

Defined results: every request gets exactly its size of distinct ids, or all ids if there are fewer; null ids are
never chosen; records without any feature are chosen last; a null, zero or negative size gives no rows; ties fall by
the hash of the id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .copies import trimmed_lower

DIMS = 1 << 20
KINDS = 4
EPSILON = 0.08
#: The last threshold; the first one is ``KINDS``.
LEAST = 0.05
TOKEN = re.compile(r"'[^']*'|\"[^\"]*\"|[a-z_]\w*|\d[\w.]*|[=<>!(]+")
NAME = re.compile(r"[a-z_][\w ]*")
#: Words of clauses, operators and common functions.
KEYWORDS = frozenset(
    "all and any as asc avg between by case cast coalesce count cross cube current desc distinct else end except exists extract fetch "
    "first from full group grouping having in inner intersect interval is join last left length like limit lower max min not null "
    "nulls offset on or order outer over partition position rank right rollup row_number rows select set sets stddev substr substring "
    "sum then trim union upper using values variance when where with".split()
)
SILENT = frozenset(("as", "and", "or", "on", "by", "asc"))


def features(statement: str) -> tuple[str, list[str], list[str]]:
    """(skeleton, its distinct words, distinct names) of a statement; values are left out."""
    skeleton: list[str] = []
    names: dict[str, None] = {}
    before = ""
    for t in TOKEN.findall(statement.lower()):
        if t[0] == "'":
            pass
        elif t[0] == '"':
            if NAME.fullmatch(t[1:-1]) and not before[-1:] in "=<>!" and before not in ("like", "in", "("):
                names[t[1:-1]] = None
        elif t in KEYWORDS:
            if t not in SILENT and (not skeleton or skeleton[-1] != t):
                skeleton.append(t)
        elif t[0].isalpha() or t[0] == "_":
            if len(t) > 2:
                names[t] = None
        before = t
    return " ".join(skeleton), sorted(set(skeleton)), list(names)


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, source, text) -> (id, kinds, bound): lists of feature numbers by kind, flat with their counts first, and the first gain."""
    from xxhash import xxh32_intdigest as h

    dims = DIMS - 1
    for batch in batches:
        out, names = [], {}
        for source, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            skeleton, words, used = features(text) if text and text.strip() else ("", [], [])
            kinds = [[h("d:" + source) & dims] if source else [], [h("s:" + skeleton) & dims] if skeleton else [], [h("w:" + w) & dims for w in words]]
            last = []
            for n in used:
                k = names.get(n)
                if k is None:
                    k = names[n] = h("n:" + n) & dims
                last.append(k)
            kinds.append(last)
            kinds = [sorted(set(k)) for k in kinds]
            out.append([len(k) for k in kinds] + [f for k in kinds for f in k])
        bound = [sum(n**0.5 / max(n, 1) ** 0.5 for n in k[:KINDS]) for k in out]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32())), pa.array(bound, pa.float64())], names=["id", "kinds", "bound"])


def weighted(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of one record and their mass."""
    counts = kinds[:KINDS]
    return kinds[KINDS:], np.repeat(1.0 / np.maximum(counts, 1) ** 2, counts)


def gain(mass: np.ndarray, at: np.ndarray, w: np.ndarray) -> float:
    have = mass[at]
    return float((np.sqrt(have + w) - np.sqrt(have)).sum())


def gains_of(own: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gain of each record, where its features start, how many they are, all features, their mass)."""
    offsets = np.asarray(lists.offsets)
    flat = np.asarray(lists.values)
    starts, n = offsets[:-1], len(lists)
    counts = np.stack([flat[starts + k] for k in range(KINDS)], axis=1)
    size = counts.sum(axis=1)
    w = np.repeat((1.0 / np.maximum(counts, 1) ** 2).ravel(), counts.ravel())
    row = np.repeat(np.arange(n), size)
    offs = np.cumsum(size) - size
    at = flat[np.repeat(starts + KINDS - offs, size) + np.arange(len(row))]
    have = own[at]
    return np.bincount(row, np.sqrt(have + w) - np.sqrt(have), n), offs, size, at, w


def spread(mass: np.ndarray):
    """The mass as the features the subset has so far, not all ``DIMS`` numbers, and a function that lays it out again."""
    used = np.flatnonzero(mass).astype(np.int32)
    amount = mass[used]

    def whole() -> np.ndarray:
        own = np.zeros(DIMS)
        own[used] = amount
        return own

    return whole


def rebound(mass: np.ndarray, chosen: np.ndarray):
    """(id, kinds, bound) -> the same with present gains, without the records chosen."""
    whole = spread(mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = whole()
        for batch in batches:
            if batch.num_rows:
                bound = pa.array(gains_of(own, batch.column(1))[0])
                left = np.flatnonzero(~np.isin(batch.column(0).to_numpy(), chosen))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bound], names=["id", "kinds", "bound"]).take(pa.array(left))

    return run


def picks(mass: np.ndarray, threshold: float, wanted: int, chosen: np.ndarray):
    """(id, kinds, bound) -> at most ``wanted`` records of a task that reach the threshold one after another."""
    whole = spread(mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = whole(), 0
        for batch in batches:
            if found >= wanted or not batch.num_rows:
                continue
            gains, offs, size, at, w = gains_of(own, batch.column(1))
            keep = []
            for i in np.flatnonzero((gains >= threshold) & ~np.isin(batch.column(0).to_numpy(), chosen)):
                s, e = offs[i], offs[i] + size[i]
                if gain(own, at[s:e], w[s:e]) >= threshold:
                    own[at[s:e]] += w[s:e]
                    keep.append(i)
                    found += 1
                    if found >= wanted:
                        break
            if keep:
                yield batch.take(pa.array(keep))

    return run


def selection_order(df: DataFrame, id_col: str, text_col: str, source_col: str, wanted: int) -> list[int]:
    """Ids of at most ``wanted`` records in the order of selection."""
    scratch = Scratch(df.sparkSession, "subset")
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), trimmed_lower(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    by_bound = F.col("bound").desc()
    table = scratch.write(rows.mapInArrow(featured, "id bigint, kinds array<int>, bound double").sortWithinPartitions(by_bound), "features0")
    mass = np.zeros(DIMS)
    chosen: dict[int, None] = {}
    threshold = renewed = float(KINDS)
    written, before = 0, 0  # how often the table was written, and how many were chosen by then
    while len(chosen) < wanted and threshold >= LEAST:
        left = wanted - len(chosen)
        if threshold <= renewed / 2:
            fresh = table.mapInArrow(rebound(mass, np.array(list(chosen)[before:], np.int64)), table.schema).sortWithinPartitions(by_bound)
            table = scratch.write(fresh, f"features{written + 1}")
            scratch.drop(f"features{written}")
            written, before, renewed = written + 1, len(chosen), threshold
        recent = np.array(list(chosen)[before:], np.int64)
        some = table.filter(F.col("bound") >= threshold - 1e-9).mapInArrow(picks(mass, threshold, left, recent), table.schema)
        got = some.orderBy(F.xxhash64("id"), "id").limit(4 * left).collect()
        dropped = 0
        for r in got:
            at, w = weighted(np.array(r["kinds"]))
            if len(chosen) == wanted:
                break
            if r["id"] in chosen or gain(mass, at, w) < threshold:
                dropped += 1
                continue
            chosen[r["id"]] = None
            mass[at] += w
        if not got or not dropped and len(got) < 4 * left and len(chosen) < wanted:
            threshold *= 1 - EPSILON
    if len(chosen) < wanted:
        for r in table.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(wanted).collect():
            if len(chosen) < wanted:
                chosen[r["id"]] = None
    return list(chosen)


def varied_subsets(df: DataFrame, requests: DataFrame, id_col: str, text_col: str, source_col: str, request_col: str = "request_id", size_col: str = "subset_size") -> DataFrame:
    """(request, id, rank) for every request. Requests and subsets are small enough for the driver: their sizes are given numbers."""
    spark = df.sparkSession
    asked = [(r[0], int(r[1])) for r in requests.select(request_col, size_col).collect() if r[1] is not None and r[1] > 0]
    order = selection_order(df, id_col, text_col, source_col, max((n for _, n in asked), default=0)) if asked else []
    rows = [(q, i, k + 1) for q, n in asked for k, i in enumerate(order[:n])]
    kind = requests.schema[request_col].dataType.simpleString()
    return spark.createDataFrame(rows, f"{request_col} {kind}, {id_col} bigint, rank int")


def p1_subset(spark, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/spider_query.parquet")
    return varied_subsets(df, spark.read.parquet(f"{sf_dir}/subset_request.parquet"), "query_id", "query", "db_id")
