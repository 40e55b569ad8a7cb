"""Evaluation texts leaking into training text.

Words of both sides are hashed; a fixed mask over ``SPAN`` consecutive words keeps some positions and ignores the others
(a spaced seed), so windows that differ at ignored positions still meet. Hits of equal mask and hash are joined and
verified on the words around them: along the diagonal of a hit the two texts are compared word by word, giving the
longest run of equal words and the longest stretch with at most a given share of substitutions.

The windows of all documents are never gathered anywhere. If the evaluation side has at most ``MAX_SENT`` distinct
hashes (its size is counted first) they are sent to the tasks, which drop all other windows before the join; beyond that
bound the join alone does it, and every window of the corpus goes through the shuffle. A repetitive text meets a repetitive
item at many pairs of positions; they are aggregated to diagonals, of which a pair has no more than the words of both.

Defined results: null or short texts leak nothing; repeated ids count once; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .statements import mix, sliced

WORDS = re.compile(r"[^\W_]+")
SPAN = 12
#: Positions that count. Any 12 equal words hit under each mask; with a substitution, under a mask that ignores its place.
MASKS = ((0, 1, 2, 4, 5, 6, 7, 9, 10, 11), (0, 1, 2, 3, 4, 7, 8, 9, 10, 11))
#: Masks for overlaps of at least 12 words of which at most 15 % are substituted: each has 5 equal words in a row, but for
#: 14 words with the fifth and tenth substituted, which hit under the second.
SEEDS = (tuple(range(5)), (0, 1, 2, 3, 5, 6, 7, 8, 10, 11, 12, 13))
#: At most so many distinct hashes of the evaluation side are sent to tasks (8 bytes each).
MAX_SENT = 2_000_000
#: Evaluation texts of at most so many characters are sent to the tasks that verify; beyond that they are joined.
MAX_TEXT = 16 << 20


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) > 200_000:
            self.clear()
        self[word] = h
        return h


def windows(only: np.ndarray | None, masks: tuple):
    """(id, text) -> (id, pos, hash) for every window and mask; with ``only``, sorted hashes, those among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in sliced(batches, 1):
            ids = batch.column(0).to_numpy()
            texts = batch.column(1).to_pylist()
            for k in range(0, len(ids), 1000):
                words = [words_of(t) for t in texts[k : k + 1000]]
                counts = np.array([len(w) for w in words], np.int64)
                flat = mix(np.array([known[w] for ws in words for w in ws], np.uint64))
                ends = np.repeat(np.cumsum(counts), counts)
                firsts = np.repeat(np.cumsum(counts) - counts, counts)
                owners = np.repeat(np.arange(len(words)), counts)
                for m, mask in enumerate(masks):
                    start = np.flatnonzero(np.arange(len(flat)) + mask[-1] + 1 <= ends)
                    if not len(start):
                        continue
                    owner, pos = owners[start], start - firsts[start]
                    h = np.full(len(start), m + 1, np.uint64)
                    for p in mask:
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[start + p])
                    h = h.view(np.int64)
                    if only is not None:
                        at = np.minimum(np.searchsorted(only, h), len(only) - 1)
                        hit = np.flatnonzero(only[at] == h) if len(only) else np.zeros(0, np.int64)
                    else:
                        hit = np.arange(len(h))
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 1000][owner[hit]]), pa.array(pos[hit].astype(np.int32)), pa.array(h[hit])], names=["id", "pos", "hash"])

    return run


def stretch(equal: np.ndarray, share: float) -> tuple[int, int]:
    """(longest run of True, longest stretch with at most this share of False, ends True)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return 0, 0
    # s to e holds if wrong[e] - share * e <= wrong[s] - share * s: for each e the least s is where the greatest so far reaches it
    wrong = np.concatenate([[0], np.cumsum(~equal)])
    level = wrong - share * np.arange(len(wrong))
    at = np.searchsorted(np.maximum.accumulate(level[starts]), level[ends] - 1e-9)
    return int((ends - starts).max()), int((ends - starts[at]).max())


def compare(share: float):
    """(doc_id, item_id, diagonals with a hit, both texts) -> (doc_id, item_id, run, overlap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, []
        known: dict[str, list[str]] = {}  # the few evaluation texts, each split once
        for batch in batches:
            docs, items, diagonals, texts, others = (c.to_pylist() for c in batch.columns)
            longest, overlaps = [], []
            for hits, text, other in zip(diagonals, texts, others):
                if text != last:
                    last, a = text, words_of(text)
                b = known.get(other)
                if b is None:
                    if len(known) > 10_000:
                        known.clear()
                    b = known[other] = words_of(other)
                most, wide = 0, 0
                for d in hits:
                    start = max(0, -d)
                    n = min(len(b), len(a) - d) - start
                    equal = np.fromiter((x == y for x, y in zip(a[start + d : start + d + n], b[start : start + n])), bool, n)
                    r, o = stretch(equal, share)
                    most, wide = max(most, r), max(wide, o)
                longest.append(most)
                overlaps.append(wide)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(longest, pa.int32()), pa.array(overlaps, pa.int32())], names=["doc_id", "item_id", "run", "overlap"])

    return run


class Measure:
    """Runs and overlaps along diagonals, on words numbered by the evaluation texts' vocabulary."""

    def __init__(self, items: dict[int, list[str]], share: float):
        self.share = share
        self.number: dict[str, int] = {}
        self.items = {i: np.array([self.number.setdefault(x, len(self.number)) for x in t], np.int64) for i, t in items.items()}

    def words(self, text: str) -> np.ndarray:
        return np.array([self.number.get(x, -1) for x in words_of(text)], np.int64)

    def __call__(self, a: np.ndarray, item: int, diagonals: list[int]) -> tuple[int, int]:
        """The longest run and overlap; a diagonal with no more equal words than were found before can't have longer ones."""
        b = self.items[item]
        lines = []
        for d in diagonals:
            start = max(0, -d)
            end = min(len(b), len(a) - d)
            equal = a[start + d : end + d] == b[start:end]
            lines.append((int(np.count_nonzero(equal)), equal))
        most, wide = 0, 0
        for n, equal in sorted(lines, key=lambda x: -x[0]):
            if n <= most and n <= wide * (1 - self.share) + 1e-6:
                break
            r, o = stretch(equal, self.share)
            most, wide = max(most, r), max(wide, o)
        return most, wide


def compare_sent(items: dict[int, list[str]], share: float):
    """(doc_id, text, found: items with their diagonals) -> (doc_id, item_id, run, overlap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(items, share)
        for batch in batches:
            docs, out_items, runs, overlaps = [], [], [], []
            for doc, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                a = measure.words(text)
                for x in found:
                    r, o = measure(a, x["item_id"], x["hits"])
                    docs.append(doc)
                    out_items.append(x["item_id"])
                    runs.append(r)
                    overlaps.append(o)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(out_items, pa.int64()), pa.array(runs, pa.int32()), pa.array(overlaps, pa.int32())], names=["doc_id", "item_id", "run", "overlap"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "item_text", share: float = 0.15, masks_needed: int = 1) -> DataFrame:
    """(doc_id, item_id, run, overlap) of every document and item with a hit: the longest run of equal words, and the

    longest overlap in words with at most ``share`` of them substituted. A window of equal words hits under every one of ``MASKS``, so
    who looks for equal runs only asks for ``len(MASKS)`` hits in one place; 1 takes ``SEEDS`` instead, which miss no overlap
    of 12 words or more with a ``share`` of at most 0.15.
    """
    masks = MASKS if masks_needed > 1 else SEEDS
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    left = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(doc_text).alias("text")).filter("id is not null and text is not null")
    right = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("text")).filter("id is not null and text is not null")
    seeds = scratch.write(right.mapInArrow(windows(None, masks), "id bigint, pos int, hash bigint").distinct(), "seeds")
    only = None
    hashes = seeds.select("hash").distinct()
    if hashes.count() <= MAX_SENT:
        only = np.sort(hashes.toArrow().column(0).to_numpy())
    found = left.mapInArrow(windows(only, masks), "id bigint, pos int, hash bigint")
    hits = found.join(seeds.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "hash"), "hash")
    if masks_needed > 1:
        hits = hits.groupBy("id", "item_id", "pos", "item_pos").count().filter(F.col("count") >= masks_needed)
    diagonals = hits.select(F.col("id").alias("doc_id"), "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
    pairs = scratch.write(diagonals.groupBy("doc_id", "item_id").agg(F.collect_set("diagonal").alias("hits")), "pairs")
    result = "doc_id bigint, item_id bigint, run int, overlap int"
    texts_of = left.select(F.col("id").alias("doc_id"), "text")
    size = right.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*"), F.count_distinct("id")).first()
    if size[0] <= MAX_TEXT and size[1] == size[2]:
        sent = {r["id"]: words_of(r["text"]) for r in right.toLocalIterator()}
        part = F.pmod(F.xxhash64("item_id"), F.lit(1 + size[1] // 1000))  # a document's items in lists of some 1,000
        found = pairs.groupBy("doc_id", part.alias("part")).agg(F.collect_list(F.struct("item_id", "hits")).alias("found"))
        checked = texts_of.join(found, "doc_id").select("doc_id", "text", "found").mapInArrow(compare_sent(sent, share), result)
    else:
        texts = pairs.join(texts_of, "doc_id").join(right.select(F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item_id")
        texts = texts.select("doc_id", "item_id", "hits", "text", "item_text").sortWithinPartitions("doc_id")  # each text is split once
        checked = texts.mapInArrow(compare(share), result)
    return checked.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("overlap").alias("overlap"))


def _inputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_item.parquet")


def p7_found(spark, sf_dir: str) -> DataFrame:
    return find_leaks(*_inputs(spark, sf_dir), masks_needed=len(MASKS)).filter(F.col("run") >= SPAN).select("doc_id", "item_id")


def p7_overlaps(spark, sf_dir: str) -> DataFrame:
    """Overlaps of at least 12 words that tolerate substitutions."""
    return find_leaks(*_inputs(spark, sf_dir)).filter(F.col("overlap") >= 12).select("doc_id", "item_id", "run", "overlap")
