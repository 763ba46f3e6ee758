"""Vectorised text scanning on Arrow buffers.

Arrow hands Python a column of texts as one contiguous UTF-8 buffer plus offsets, so whole
batches can be split into words, hashed and summed by NumPy without making a Python string
per word. Every function here is pure and works on one slice of a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wrapping arithmetic)."""
    h = (h ^ (h >> _S32)) * _C1
    h = (h ^ (h >> _S29)) * _C2
    return h ^ (h >> _S32)


def separators(extra: str = "") -> np.ndarray:
    """Byte table: True for ASCII white space, control bytes and the characters of extra."""
    table = np.zeros(256, dtype=bool)
    table[:33] = True
    table[127] = True
    for c in extra.encode("ascii"):
        table[c] = True
    return table


SPACE = separators()
PUNCT = separators("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 int64 offsets of a text column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; a longer text makes a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of non-separator bytes; a run ends with its row."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~table[data]
    edge = np.empty(len(data), dtype=bool)
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    first = offsets[:-1]
    edge[first[first < len(data)]] = True
    cuts = np.flatnonzero(edge)
    ends = np.append(cuts[1:], len(data))
    keep = inside[cuts]
    start, end = cuts[keep], ends[keep]
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = end - start
    h = mix(length.astype(np.uint64) + np.uint64(seed & (2**64 - 1)) * _C2 + _C1)
    h = mix(h ^ (view[start] & _MASK[np.minimum(length, 8)]))
    at, rest = np.flatnonzero(length > 8), 8
    while len(at):
        left = length[at] - rest
        h[at] = mix(h[at] ^ (view[start[at] + rest] & _MASK[np.minimum(left, 8)]))
        at, rest = at[left > 8], rest + 8
    return h


def shingles(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Order-sensitive hashes of runs of k words of one row, and their rows. A row of under k words gives one shingle of all of them."""
    n = len(words)
    if n == 0:
        return words, row
    h = words.copy()
    ok = np.ones(n, dtype=bool)
    for j in range(1, k):
        h[: n - j] = mix(h[: n - j] * _C1 + words[j:])
        h[max(0, n - j) :] = h[max(0, n - j) :]
        ok[: n - j] &= row[j:] == row[: n - j]
        ok[max(0, n - j) :] = False
    firsts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    counts = np.diff(np.r_[firsts, n])
    short = firsts[counts < k]
    if len(short):
        size = counts[counts < k]
        total = words[short].copy()
        for j in range(1, k):
            more = size > j
            total[more] = mix(total[more] * _C1 + words[short[more] + j])
        h[short] = total
        ok[short] = True
    return h[ok], row[ok]
