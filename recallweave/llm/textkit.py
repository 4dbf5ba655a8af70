"""Vectorised text primitives shared by the corpus operators.

All of them work on blocks of whole texts taken from an Arrow column without making Python strings:
one block is a byte array with document offsets, bounded in bytes (a single longer text is a block of
its own), so a worker's memory follows the longest text and not the batch size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20

#: Separators of words: 0x20 and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that depend on the seed alone."""
    base = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 0xC2B2AE3D27D4EB4F % (1 << 64))
    return mix(mix(base)) | U64(1)


BYTE = constants(256, 11)
#: Bases of the rolling sums: the hash of a span, and a second one where 64 bits are too few.
_STEPS = (0xF1357AEA2E62A9C5, 0x9FB21C651E98DF25)
#: Bytes that are hashed at a time; so tables and temporary arrays don't grow with a text.
WINDOW = 1 << 19


@functools.cache
def powers(base: int) -> np.ndarray:
    """base**0 .. base**WINDOW modulo 2**64."""
    have = np.ones(1, U64)
    while len(have) <= WINDOW:
        have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
    return have[: WINDOW + 1]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) with at most `limit` bytes or one text."""
    raw, at = string_buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def code_points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points) of a block."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return points, lead[at]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of each word of a block, in order; words end with their document."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SEPARATOR[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, way: int = 0) -> np.ndarray:
    """64-bit hashes of spans of a block, equal for equal bytes wherever they stand. Starts and ends must both
    ascend; spans may overlap. Two ways give independent hashes. Bytes are read a window at a time; a span that goes
    on over an edge carries its sum along."""
    step, out = _STEPS[way], np.zeros(len(start), U64)
    up, down = powers(step), powers(pow(step, -1, 1 << 64))
    for a in range(0, len(raw), WINDOW):
        b = min(a + WINDOW, len(raw))
        i, j = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))
        if i >= j:
            continue
        run = np.zeros(b - a + 1, U64)
        np.cumsum(BYTE[raw[a:b]] * up[: b - a], out=run[1:])
        s, e = np.maximum(start[i:j], a) - a, np.minimum(end[i:j], b) - a
        part = (run[e] - run[s]) * down[s]
        for k in range(int(np.searchsorted(start[i:j], a, "left"))):
            part[k] = int(part[k]) * pow(step, a - int(start[i + k]), 1 << 64) & 0xFFFFFFFFFFFFFFFF
        out[i:j] += part
    return mix(out + (end - start).astype(U64) * U64(2 * way + 1))


_SHINGLE = constants(16, 23)


def shingle_hashes(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by document) of the word shingles of a block, A-Z lower-cased, repeats included.

    A document with fewer words than `size` has one shingle, its whole sequence; without words, none."""
    low = LOWER[raw]
    start, end, doc = words(low, at)
    word = span_hash(low, start, end)
    n = len(at) - 1
    if n == 1 and len(word) >= size:  # a long text is a block of its own: no arrays but the hashes
        del low, start, end, doc
        out = np.zeros(len(word) - size + 1, U64)
        for k in range(size):
            out += word[k : k + len(out)] * _SHINGLE[k]
        return mix(out + U64(size)), np.array([0, len(out)])
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    out = np.zeros(max(0, len(word) - size + 1), U64)
    for k in range(size):
        out += word[k : k + len(out)] * _SHINGLE[k]
    out = mix(out + U64(size))
    full = count >= size
    take = np.where(full, count - size + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(take)])
    values = np.zeros(offsets[-1], U64)
    if len(out):
        owner = doc[: len(out)]
        inside = np.arange(len(out)) - first[owner] < count[owner] - size + 1
        at_full = np.repeat(full, take)
        values[at_full] = out[inside]
    for d in np.flatnonzero(~full & (count > 0)):
        w = word[first[d] : first[d] + count[d]]
        values[offsets[d]] = mix(np.sum(w * _SHINGLE[: len(w)], dtype=U64, keepdims=True) + U64(len(w)))[0]
    return values, offsets


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of rows with one value in the first column, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = np.asarray(batch.column(0))
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and len(key) and held[-1].column(0)[-1].as_py() != key[0]:
            cuts = np.concatenate([[0], cuts])
        at = 0
        for cut in cuts:
            part = [*held, batch.slice(at, cut - at)]
            yield pa.Table.from_batches([p for p in part if p.num_rows])
            held, at = [], int(cut)
        held.append(batch.slice(at))
    rest = [h for h in held if h.num_rows]
    if rest:
        yield pa.Table.from_batches(rest)
