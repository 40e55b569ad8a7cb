"""Encoding of a corpus with a public byte-level BPE vocabulary, and decoding.

Long texts are cut into chunks that overlap; chunks are split into pre-tokens in parallel. A chunk that starts in the
middle of a pre-token falls into step with its predecessor at the first pre-token boundary both see in the overlap. The
text is cut there, the pieces are encoded in parallel and their ids put together in order. Where two chunks never fall
into step, the piece simply runs on. A cut is only made after a character that isn't white space, as a run of
white space is split by what follows it.

Defined results: an empty and a null text give an empty list; every input row gives one row; special tokens are not
recognised, their strings are ordinary text; each of several rows with one id, or with none, is encoded by itself.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

VOCABULARY = os.environ.get("LOOMSQL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How this vocabulary splits text before merging; a fixed value that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 8_192
OVERLAP = 1_024
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
SPACE = re.compile(LONG_SPACE.pattern.partition("{")[0])
_encoders: dict = {}


def encoder(path: str, pattern: str = PATTERN):
    """The encoder of one vocabulary file, once per process."""
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def decode(ids: list[int], path: str = VOCABULARY) -> bytes:
    """The bytes of the tokens one after another."""
    return encoder(path).decode_bytes(ids)


def encode(enc, text: str) -> list[int]:
    """Ids of one text. The library overflows its stack on very long runs of white space, so these are cut out first:

    such a run is one pre-token up to its last character, which belongs to what follows, or up to the end of the text.
    """
    at, out = 0, []
    for m in LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : end].encode())
        at = end
    return out + enc.encode_ordinary(text[at:])


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            ids = [encode(enc, t) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "ids"])

    return run


def boundaries(text: str, pattern: str, final: bool) -> list[int]:
    """Starts of pre-tokens that follow a visible character. Unless it is the text's end, what may change there is left out."""
    import regex

    out, limit = [], len(text) - 1
    pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    for m in regex.finditer(pattern, text):
        if not final and m.end() >= limit:
            break
        if m.end() < len(text) and not SPACE.match(text[m.end() - 1]):
            out.append(m.end())
    return out


def _chunks(chunk: int, overlap: int):
    """(h, text) -> (h, last, idx, text): the chunks of each text with what follows them, cut in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                last = (len(text) - overlap - 1) // chunk
                for k in range(0, last + 1, 1000):
                    idx = range(k, min(k + 1000, last + 1))
                    n = len(idx)
                    yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array([last] * n, pa.int64()), pa.array(idx, pa.int64()), pa.array([text[i * chunk : (i + 1) * chunk + overlap] for i in idx], pa.string())], names=["h", "last", "idx", "text"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, text, cuts) -> (h, cut, text): the pieces between the cuts, which alone travel on."""
    for batch in batches:
        for h, text, cuts in zip(*(batch.column(k).to_pylist() for k in range(3))):
            at = [0, *(c for c in cuts or () if c), len(text)]
            for k in range(0, len(at) - 1, 1000):
                part = at[k : k + 1001]
                n = len(part) - 1
                yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array(part[:-1], pa.int64()), pa.array([text[a:b] for a, b in zip(part, part[1:])], pa.string())], names=["h", "cut", "text"])


def _edges(pattern: str, chunk: int, overlap: int):
    """(doc, last, idx, text) -> (doc, idx, head, tail): boundaries in the overlaps with the chunks before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, lasts, idxs, texts = (c.to_pylist() for c in batch.columns)
            heads, tails = [], []
            for last, idx, text in zip(lasts, idxs, texts):
                found = boundaries(text, pattern, idx == last)
                start = idx * chunk
                heads.append([start + p for p in found if p <= overlap])
                tails.append([start + p for p in found if p >= chunk])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(idxs, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=["doc", "idx", "head", "tail"])

    return run


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids) for every row."""
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    texts = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    n_chars = F.coalesce(F.length("text"), F.lit(0))
    short = texts.filter(n_chars <= chunk + overlap)
    kind = texts.schema["doc"].dataType.simpleString()
    done = short.mapInArrow(_encode(vocabulary, pattern), f"doc {kind}, ids array<int>")

    scratch = Scratch(df.sparkSession, "tokens")
    long = texts.filter(n_chars > chunk + overlap).select(F.monotonically_increasing_id().alias("h"), "doc", "text")
    if long.isEmpty():
        return done.select(F.col("doc").alias(id_col), "ids")
    long = scratch.write(long, "long")
    chunks = long.select("h", "text").mapInArrow(_chunks(chunk, overlap), "h bigint, last bigint, idx bigint, text string").repartition("h", "idx")
    edges = chunks.mapInArrow(_edges(pattern, chunk, overlap), "doc bigint, idx bigint, head array<bigint>, tail array<bigint>")
    w = Window.partitionBy("doc").orderBy("idx")
    cuts = edges.select("doc", "idx", F.array_min(F.array_intersect("tail", F.lead("head").over(w))).alias("cut"), F.lead("idx").over(w).isNotNull().alias("more")).filter("more")
    # A cut holds only if its chunk was in step, so the first failure ends the list.
    sound = F.min(F.col("cut").isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, 0))
    cuts = cuts.select("doc", "cut", sound.alias("sound")).filter("sound").select(F.col("doc").alias("h"), "cut")
    starts = cuts.groupBy("h").agg(F.sort_array(F.collect_set("cut")).alias("cuts"))  # one number for each chunk of a text
    pieces = long.select("h", "text").join(starts, "h", "left").mapInArrow(_pieces, "h bigint, cut bigint, text string")
    coded = pieces.repartition("h", "cut").mapInArrow(_encode(vocabulary, pattern), "h bigint, cut bigint, ids array<int>")
    whole = coded.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("cut", "ids"))).alias("parts")).select("h", F.flatten("parts.ids").alias("ids"))
    joined = long.select("h", "doc").join(whole, "h").select("doc", "ids")
    return done.unionByName(joined).select(F.col("doc").alias(id_col), "ids")


def p6_ids(spark, sf_dir: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def p6_chunked(spark, sf_dir: str) -> DataFrame:
    """(doc_id, same): whether chunks of 300 characters, stitched, give each document the ids its whole text has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = encode_corpus(docs, "doc_id", "text", chunk=300, overlap=100)
    whole = docs.select("doc_id", "text").mapInArrow(_encode(VOCABULARY, PATTERN), "doc_id bigint, ids array<int>")
    both = whole.join(parts.withColumnRenamed("ids", "stitched"), "doc_id", "left")
    return both.select("doc_id", F.coalesce(F.col("ids") == F.col("stitched"), F.lit(False)).alias("same"))
