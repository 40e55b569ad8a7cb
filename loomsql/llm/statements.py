"""Statement fingerprints that disregard layout, and an exact comparison of colliding statements.

A statement is read as a stream of UTF-8 bytes through one 256-entry lookup table: white space, semicolons and
quoting marks map to 0 and are skipped, capital letters fold to small ones. The bytes that remain feed two rolling
polynomial hashes per segment; canonical strings are never built. Segments are what stands before the outermost
select list, each item of that list, and what follows; item hashes are added up, so their order doesn't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Skipped bytes: ASCII white space and separators, semicolon, quoting marks.
SKIPPED = b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f;'\"`[]"
TABLE = np.arange(256, dtype=np.uint8)
TABLE[65:91] += 32
TABLE[list(SKIPPED)] = 0
TABLE[0] = 255  # a NUL byte counts like any other content

TOKENS = re.compile(
    rb"'[^']*(?:'|\Z)|\"[^\"]*(?:\"|\Z)|`[^`]*(?:`|\Z)|\[[^\]]*(?:\]|\Z)|[(),;]|\b(?:select|from|union|except|intersect)\b", re.I
)
MODIFIER = re.compile(rb"[\s;]*(?:distinct|all)\b", re.I)
MOD1, MOD2 = np.uint64(2**31 - 1), np.uint64(2**31 - 19)
BASE1, BASE2 = 1_000_003, 998_244_341
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def sliced(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose texts in one column hold at most ``limit`` bytes, or of one row.

    Vectorised work takes some 50 bytes for each byte of text, so this bounds a task's memory whatever the texts' length.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of both bases; the tables double as longer segments come."""
    for k, (base, mod) in enumerate(((BASE1, MOD1), (BASE2, MOD2))):
        while len(_powers[k]) < n:
            have = _powers[k]
            step = np.uint64(pow(base, len(have), int(mod)))
            _powers[k] = np.concatenate([have, have * step % mod])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def select_list(data: bytes) -> list[int]:
    """Boundaries of the outermost select list: where it starts, its commas, where it ends.

    Empty if there is no SELECT. The outermost list is the first one outside all parentheses, else the first one.
    """
    depth, found, base, fallback = 0, -1, 0, None
    commas: list[int] = []
    for m in TOKENS.finditer(data):
        t = data[m.start()]
        if t == 40:  # (
            depth += 1
        elif t == 41:  # )
            if found >= 0 and depth == base:
                return [found, *commas, m.start()]
            depth -= 1
        elif found < 0:
            if t in b"sS" and (depth <= 0 or fallback is None):
                where = MODIFIER.match(data, m.end())
                at = where.end() if where else m.end()
                if depth <= 0:
                    found, base = at, depth
                else:
                    fallback = (m.start(), at)
        elif depth == base:
            if t == 44:  # ,
                commas.append(m.start())
            elif t in b"fFuUeEiI;":
                return [found, *commas, m.start()]
    if found >= 0:
        return [found, *commas, len(data)]
    if fallback is None:
        return []
    inner, depth, commas = fallback[1], 0, []
    for m in TOKENS.finditer(data, inner):
        t = data[m.start()]
        if t == 40:
            depth += 1
        elif t == 41:
            depth -= 1
            if depth < 0:
                return [inner, *commas, m.start()]
        elif depth == 0 and t == 44:
            commas.append(m.start())
        elif depth == 0 and t in b"fFuUeEiI;":
            return [inner, *commas, m.start()]
    return [inner, *commas, len(data)]


def _plain(text: str) -> str:
    """Letter case and white space beyond ASCII, for the few texts that have any."""
    return "".join(" " if ch.isspace() else ch for ch in text.lower())


class Profile:
    """Segments and hashes of a batch of non-null texts."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        data, offsets = self._buffers(texts)
        if len(data) and np.frombuffer(data, np.uint8).max() > 127:
            texts = pa.array([_plain(x) if not x.isascii() else x for x in texts.to_pylist()], pa.large_string())
            data, offsets = self._buffers(texts)
        self.n = len(texts)
        starts: list[int] = []
        ends: list[int] = []
        kinds: list[int] = []
        counts = np.empty(self.n, np.int64)
        bounds = offsets.tolist()
        for i in range(self.n):
            s, e = bounds[i], bounds[i + 1]
            cut = [s + c for c in select_list(data[s:e])]
            if len(cut) < 2:
                starts.append(s), ends.append(e), kinds.append(0)
                counts[i] = 1
                continue
            k = len(cut)
            starts.append(s)
            starts.append(cut[0])
            starts.extend([c + 1 for c in cut[1:-1]])
            starts.append(cut[-1])
            ends.extend(cut)
            ends.append(e)
            kinds.append(0)
            kinds.extend([1] * (k - 1))
            kinds.append(2)
            counts[i] = k + 1
        codes = TABLE[np.frombuffer(data, np.uint8)] if data else np.empty(0, np.uint8)
        self.codes = codes
        self.kept = np.flatnonzero(codes)
        self.row_seg = np.concatenate([[0], np.cumsum(counts)])
        seg_row = np.repeat(np.arange(self.n), counts)
        kind = np.asarray(kinds, np.uint64)
        first = np.searchsorted(self.kept, np.asarray(starts, np.int64))
        length = np.searchsorted(self.kept, np.asarray(ends, np.int64)) - first
        offs = np.concatenate([[0], np.cumsum(length)])
        rank = np.arange(offs[-1]) - np.repeat(offs[:-1], length)
        values = codes[self.kept[np.repeat(first, length) + rank]].astype(np.uint64)
        p1, p2 = powers(int(length.max()) + 1 if len(length) else 1)
        h = np.zeros(len(length), np.uint64)
        for p, mod, shift in ((p1, MOD1, 31), (p2, MOD2, 0)):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * p[rank])])
            h |= ((total[offs[1:]] - total[offs[:-1]]) % mod) << np.uint64(shift)
        h = mix(h + kind * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
        rows = total[self.row_seg[1:]] - total[self.row_seg[:-1]]
        self.signature = mix(rows + counts.astype(np.uint64)).view(np.int64)
        kept_total = np.concatenate([[0], np.cumsum(length)])
        self.blank = kept_total[self.row_seg[1:]] == kept_total[self.row_seg[:-1]]
        order = np.lexsort((length, h, kind, seg_row))
        self.first, self.length = first[order], length[order]

    @staticmethod
    def _buffers(texts: pa.Array) -> tuple[bytes, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = raw[int(offsets[0]) : int(offsets[-1])].to_pybytes() if raw is not None and len(texts) else b""
        return data, offsets - offsets[0]

    def _cursor(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment lengths, and the kept bytes, of these rows in canonical order of their segments."""
        count = self.row_seg[rows + 1] - self.row_seg[rows]
        offs = np.concatenate([[0], np.cumsum(count)])
        seg = np.repeat(self.row_seg[rows], count) + np.arange(offs[-1]) - np.repeat(offs[:-1], count)
        length = self.length[seg]
        at = np.concatenate([[0], np.cumsum(length)])
        pos = np.repeat(self.first[seg], length) + np.arange(at[-1]) - np.repeat(at[:-1], length)
        return count, length, pos

    def equal(self, rows: np.ndarray, other: "Profile", others: np.ndarray) -> np.ndarray:
        """For each pair whether the statements agree: a cursor in each text steps over skipped bytes."""
        ca, la, pa_ = self._cursor(rows)
        cb, lb, pb = other._cursor(others)
        good = ca == cb
        if not good.all():
            return self._some(rows, other, others, good)
        starts = np.concatenate([[0], np.cumsum(ca)])[:-1]
        good = np.logical_and.reduceat(la == lb, starts) if len(la) else good
        if not good.all():
            return self._some(rows, other, others, good)
        if not len(pa_):
            return good
        differ = np.concatenate([[0], np.cumsum(self.codes[self.kept[pa_]] != other.codes[other.kept[pb]])])
        ends = np.concatenate([[0], np.cumsum(la)])[np.concatenate([starts, [len(la)]])]
        return differ[ends[1:]] == differ[ends[:-1]]

    def _some(self, rows: np.ndarray, other: "Profile", others: np.ndarray, good: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), bool)
        if good.any():
            out[good] = self.equal(rows[good], other, others[good])
        return out


def canonical(text: str) -> bytes:
    """The exact canonical form of one statement. Used only for rows whose comparison found a hash collision."""
    data = _plain(text).encode("utf-8", "surrogatepass")
    cut = select_list(data)
    fold = bytes(TABLE.tolist())
    clean = lambda b: b.translate(fold, SKIPPED)
    if len(cut) < 2:
        return clean(data)
    items = sorted(clean(data[a:b]) for a, b in zip([cut[0], *(c + 1 for c in cut[1:-1])], cut[1:]))
    return b"\0".join([clean(data[: cut[0]]), *items, clean(data[cut[-1] :])])
