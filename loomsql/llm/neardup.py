"""Near-duplicate texts with small edits.

Texts are sets of word shingles. Equal word sequences are merged first, in the tasks and then by key. Each distinct
text gets a *fast similarity sketch*: in round i every element throws one ball (i, h_i) into a bin chosen by its hash,
a bin keeps the least ball; from round t on, ball i goes to bin i - t, so all t bins fill within 2t rounds, and usually
after about t log t / n. Two sketches agree in a bin with the probability of the texts' similarity, with the
concentration of t independent hash functions. Bands of ``rows`` bins make buckets; candidate pairs of a bucket are
verified on the words themselves; verified links chain by :mod:`loomsql.llm.contraction`.

With the defaults a pair at the threshold 0.6 shares no band with probability (1 - 0.6^4)^60 = 2.4e-4, far less above it.

Hot buckets: in a bucket of at most ``WINDOW + 1`` texts all pairs are compared; in a larger one each text first meets the
least id and its ``WINDOW`` predecessors, and the links found are contracted. A bucket that a batch fills with more than
``CROWD`` texts is split there: the batch's texts make a bucket of their own and only their least id goes on to meet the rest,
so no task gets more than a row a batch of a bucket that holds a third of all texts. Pairs inside one component need no more.
Large buckets and parts of split ones that share texts make one group (contraction again); the texts of groups that hold several
components are then joined exactly (:func:`across`): a pair at the threshold shares one of the first n - ceil(threshold * n) + 1
shingles of both texts in any common order (rarest first here), so every pair of different components among them is found with
certainty, or ruled out by its sizes and positions.

Hot classes of equal texts are merged within each batch before the shuffle, and by an aggregation with a map-side part.

Defined results: null texts and texts of fewer than ``min_words`` words have no group; equal word sequences are linked;
texts linked to nothing yield no row; an empty table yields no rows; further columns are ignored.
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
from .contraction import components
from .statements import mix, sliced

WORDS = re.compile(r"\w+")
WINDOW = 32
#: A batch with more texts than this in one bucket makes a bucket of them.
CROWD = 64
SLOTS = 1 << 18
KEEP_BYTES = 16 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
STAGE = "kind string, rep_id bigint, copy_id bigint, min_id bigint, wkey binary, words string"
_STAGE = pa.schema([("kind", pa.string()), ("rep_id", pa.int64()), ("copy_id", pa.int64()), ("min_id", pa.int64()), ("wkey", pa.binary()), ("words", pa.string())])


def merge_equal(min_words: int):
    """(id, text) -> R rows (kind r) with the words of each sequence a task met, and E rows (kind e) of its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, list] = {}
        size = 0

        def flush(rows: list) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array(["r"] * n), pa.array([r[0] for r in rows], pa.int64()), pa.nulls(n, pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.string())], schema=_STAGE)

        for batch in batches:
            now, reps, copies = {}, [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORDS.findall(text.lower())
                if len(words) < min_words:
                    continue
                joined = " ".join(words)
                key = blake2b(joined.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                have = kept.get(key) or now.get(key)
                if have is not None:
                    reps.append(have[0])
                    copies.append(i)
                    have[1] = min(have[1], i)
                elif size < KEEP_BYTES:
                    kept[key] = [i, i, key, joined]
                    size += len(joined) + 250
                else:
                    now[key] = [i, i, key, joined]
            if now:
                yield flush(list(now.values()))
            if copies:
                n = len(copies)
                yield pa.RecordBatch.from_arrays([pa.array(["e"] * n), pa.array(reps, pa.int64()), pa.array(copies, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.string())], schema=_STAGE)
        rows = list(kept.values())
        for k in range(0, len(rows), 10_000):
            yield flush(rows[k : k + 10_000])

    return run


class _WordHash(dict):
    """word -> 64-bit hash, remembered for a batch."""

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = h
        return h


def shingle_hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct runs of ``size`` words; a shorter text is one shingle."""
    known = _WordHash()
    words = [t.split(" ") for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = np.array([known[w] for ws in words for w in ws], np.uint64)
    row = np.repeat(np.arange(len(texts)), counts)
    h = mix(flat + np.uint64(1))
    out = h.copy()
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(flat))
    for k in range(1, size):
        inside = at + k < ends
        out[inside] = mix(out[inside] * np.uint64(0x9E3779B97F4A7C15) + h[at[inside] + k])
    whole = (at + size <= ends) | (at == ends - np.repeat(counts, counts))
    row, out = row[whole], out[whole]
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (out[1:] != out[:-1])]) if len(row) else np.zeros(0, bool)
    return row[new], out[new]


def sketches(row: np.ndarray, elements: np.ndarray, n: int, t: int) -> np.ndarray:
    """n x t sketches of the sets given as (row, element), rows in order."""
    bins = np.full(n * t, NONE, np.uint64)
    for i in range(2 * t):
        h = mix(elements + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(bins, row * t + at, (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        if i % 4 == 3 or i >= t:
            open_ = (bins.reshape(n, t) == NONE).any(axis=1)
            live = open_[row]
            if not live.any():
                break
            row, elements = row[live], elements[live]
    return bins.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """n x bands bucket keys of ``rows`` bins each."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(t // rows, dtype=np.uint64), (n, t // rows)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0xD1B54A32D192ED03) + parts[:, :, k])
    return key


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def shingles(words: str, size: int) -> set:
    w = words.split(" ")
    return set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)}


def bucket_rows(size: int, bands: int, rows: int):
    """(id, words) -> (key, id, split) for each band; ``split``: the id stands for a crowd that has a bucket of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            ids = batch.column(0).to_numpy()
            texts = batch.column(1).to_pylist()
            row, h = shingle_hashes(texts, size)
            keys = band_keys(sketches(row, h, len(ids), bands * rows), rows)
            key, who = parted(keys.ravel(), np.repeat(ids, bands))
            split = np.arange(len(key)) >= keys.size
            for k in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 100_000]), pa.array(who[k : k + 100_000]), pa.array(split[k : k + 100_000])], names=["key", "id", "split"])

    return run


def parted(key: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Crowded buckets of one batch get keys of their own; after all rows comes the least id of each under its old key."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    crowd = np.flatnonzero(size > CROWD)
    if not len(crowd):
        return key.view(np.int64), who
    key, least = key.copy(), np.array([who[order[start[c] : start[c] + size[c]]].min() for c in crowd], np.int64)
    for c, first in zip(crowd, least):
        at = order[start[c] : start[c] + size[c]]
        key[at] = mix(key[at] + np.array([first], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return np.concatenate([key, sorted_key[start[crowd]]]).view(np.int64), np.concatenate([who, least])


def bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) in order of key and id -> candidate pairs (a, b), a < b."""
    for batch in flagged_pairs(batches):
        yield batch.select(["a", "b"])


def flagged_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same with ``far``: the pair lies in a bucket too large for all its pairs, or in one that was split.

    Rows come with ``split``, those of one bucket first where it holds. Carries the last bucket's end along.
    """
    tail_key, tail, leader, parts = None, np.empty(0, np.int64), 0, False
    for batch in batches:
        key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        split = np.asarray(batch.column(2)) if batch.num_columns > 2 else np.zeros(len(key), bool)
        carried = len(tail) if tail_key is not None and key[0] == tail_key else 0
        if carried:
            key = np.concatenate([np.full(carried, tail_key), key])
            ids = np.concatenate([tail, ids])
            split = np.concatenate([np.full(carried, parts), split])
        start_of = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(key)), 0))
        first, of_parts = ids[start_of], split[start_of]
        if carried:
            first[start_of == 0] = leader
        found = []
        for d in range(1, WINDOW + 1):
            at = np.flatnonzero(np.arange(len(key)) - d >= start_of)
            at = at[at >= carried]
            if not len(at):
                break
            found.append((ids[at - d], ids[at], of_parts[at]))
        far = np.flatnonzero((first != ids) & (np.arange(len(key)) - start_of > (0 if carried else WINDOW)))
        far = far[far >= carried]
        found.append((first[far], ids[far], of_parts[far] | (far - start_of[far] >= WINDOW)))
        a, b, large = (np.concatenate([x[k] for x in found]) for k in range(3))
        a, b = np.minimum(a, b), np.maximum(a, b)
        differ = a != b
        if differ.any():
            pairs = np.unique(np.stack([a[differ], b[differ], large[differ].astype(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2] > 0)], names=["a", "b", "far"])
        last = start_of[-1]
        tail_key, leader, parts = key[-1], int(first[-1]), bool(of_parts[-1])
        tail = ids[max(last, len(ids) - WINDOW) :]


def verified(size: int, threshold: float):
    """(a, b, words_a, words_b) -> (a, b) of the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, have = [], None, set()
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if y != last:
                    last, have = y, shingles(y, size)
                if jaccard(shingles(x, size), have) >= threshold:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return run


def slot_counts(size: int):
    """(id, comp, words) -> (slot, n): how many texts have a shingle of each of ``SLOTS`` hash slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in sliced(batches, 2):
            _, h = shingle_hashes(batch.column(2).to_pylist(), size)
            total += np.bincount((h % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    return run


def prefixes(size: int, threshold: float, common: np.ndarray):
    """(id, comp, words) -> (token, id, comp, n, pos): the rarest shingles of a text, enough to meet every text at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            row, h = shingle_hashes(batch.column(2).to_pylist(), size)
            order = np.lexsort((h, common[(h % np.uint64(SLOTS)).astype(np.int64)], row))
            row, h = row[order], h[order]
            n = np.bincount(row, minlength=batch.num_rows)
            pos = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            keep = np.flatnonzero(pos <= (n - np.ceil(threshold * n - 1e-9))[row])
            row = row[keep]
            who = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), batch.column(0).take(who), batch.column(1).take(who), pa.array(n[row].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["token", "id", "comp", "n", "pos"])

    return run


def with_words(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    joined = pairs.join(docs.select(F.col("id").alias("a"), F.col("words").alias("words_a")), "a").join(docs.select(F.col("id").alias("b"), F.col("words").alias("words_b")), "b")
    return joined.select("a", "b", "words_a", "words_b")


def across(docs: DataFrame, pairs: DataFrame, labels: DataFrame, scratch: Scratch, size: int, threshold: float) -> DataFrame | None:
    """Links (a, b) between different components of the texts whose groups of large buckets hold several; None if there are none.

    In the group of a shingle the texts outside its largest component meet all others, so a big family costs no more than
    its rows times the strays among them.
    """
    label = labels.select(F.col("vertex").alias("id"), F.col("root").alias("comp"))
    far = pairs.filter("far").select("a", "b")
    ends = far.join(label.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left").join(label.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
    if ends.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).isEmpty():  # then no group holds several components
        return None
    group = components(far.toDF("u", "v"), Scratch(docs.sparkSession, "neardup-far")).select(F.col("vertex").alias("id"), F.col("root").alias("grp"))
    group = scratch.write(group.join(label, "id", "left").select("id", "grp", F.coalesce("comp", "id").alias("comp")), "around")
    mixed = group.groupBy("grp").agg((F.min("comp") != F.max("comp")).alias("mixed")).filter("mixed").select("grp")
    members = scratch.write(group.join(mixed, "grp", "left_semi").select("id"), "members")
    texts = docs.join(members, "id", "left_semi").join(label, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), "words")
    texts = scratch.write(texts, "strays")
    counts = texts.mapInArrow(slot_counts(size), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(SLOTS, np.int64)
    common[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    rare = scratch.write(texts.mapInArrow(prefixes(size, threshold, common), "token bigint, id bigint, comp bigint, n int, pos int"), "rare")
    by_comp = rare.groupBy("token", "comp").agg(F.count("*").alias("k"))
    giants = by_comp.groupBy("token").agg(F.max_by("comp", "k").alias("giant"), F.count("*").alias("comps")).filter("comps > 1").select("token", "giant")
    x = rare.join(giants, "token").filter("comp <> giant").select("token", "giant", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    met = x.join(rare, "token").filter("comp <> cx and (comp = giant or x < id)").filter(F.least("n", "nx") >= threshold * F.greatest("n", "nx") - 1e-9)
    met = met.filter(F.least(F.col("n") - F.col("pos"), F.col("nx") - F.col("px")) >= threshold / (1 + threshold) * (F.col("n") + F.col("nx")) - 1e-6)
    candidates = met.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
    return scratch.write(with_words(candidates, texts).mapInArrow(verified(size, threshold), "a bigint, b bigint"), "more")


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (vertex, root) after further links."""
    ends = links
    for c in ("a", "b"):
        ends = ends.join(labels.select(F.col("vertex").alias(c), F.col("root").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    top = scratch.write(components(ends.select(F.col("ca").alias("u"), F.col("cb").alias("v")), scratch), "top")
    moved = labels.join(top.select(F.col("vertex").alias("root"), F.col("root").alias("top")), "root", "left").select("vertex", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(top.join(labels.select("vertex"), "vertex", "left_anti"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, size: int = 5, threshold: float = 0.8, min_words: int = 1, bands: int = 60, rows: int = 4) -> DataFrame:
    """(first_id, id) for every record of a group but its least id, which is ``first_id``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "neardup")
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    stage = scratch.write(texts.mapInArrow(merge_equal(min_words), STAGE), "stage", partition_by="kind")
    edges = stage.filter("kind = 'e'").select("rep_id", "copy_id")
    met = stage.filter("kind = 'r'")
    firsts = scratch.write(met.groupBy("wkey").agg(F.min("min_id").alias("id"), F.first("words").alias("words")), "firsts")
    reps = scratch.write(met.select("rep_id", "wkey").join(firsts.select("wkey", F.col("id").alias("doc")), "wkey").select("rep_id", "doc"), "reps")
    scratch.drop("stage/kind=r")
    docs = firsts.select("id", "words")
    buckets = docs.mapInArrow(bucket_rows(size, bands, rows), "key bigint, id bigint, split boolean")
    flagged = buckets.repartition("key").sortWithinPartitions("key", F.desc("split"), "id").mapInArrow(flagged_pairs, "a bigint, b bigint, far boolean")
    pairs = scratch.write(flagged.groupBy("a", "b").agg(F.bool_or("far").alias("far")), "pairs")
    links = with_words(pairs.select("a", "b"), docs).mapInArrow(verified(size, threshold), "a bigint, b bigint")
    labels = scratch.write(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch), "labels")
    more = across(docs, pairs, labels, scratch, size, threshold)
    scratch.drop("pairs")
    if more is not None:
        labels = merged(labels, more, Scratch(spark, "neardup-more"))
    least = labels.groupBy("root").agg(F.min("vertex").alias("first_id"))
    groups = labels.join(least, "root").select(F.col("vertex").alias("doc"), "first_id")
    classes = reps.select("rep_id", "doc").join(groups, "doc", "left").select("rep_id", F.coalesce("first_id", "doc").alias("first_id"))
    classes = scratch.write(classes, "classes")
    members = classes.select("first_id", F.col("rep_id").alias("id")).unionByName(classes.join(edges, "rep_id").select("first_id", F.col("copy_id").alias("id")))
    return members.filter("id <> first_id")


def p5_found(spark, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/spider_query.parquet")
    return near_duplicates(df, "query_id", "query", size=3, threshold=0.6, min_words=20).select("first_id", F.col("id").alias("query_id"))
