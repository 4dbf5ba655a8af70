"""Terms of whole texts: maximal runs of ASCII letters and digits (A-Z lower-cased) and of anything beyond ASCII, as UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .textkit import blocks

#: By byte: what a term keeps of it; all else parts terms.
KEPT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a longer text that are split at a time.
WINDOW = 1 << 20


def term_list(raw: bytes) -> list[bytes]:
    return raw.translate(KEPT).split()


def windows(raw: bytes, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of about `size` bytes of a text that KEPT has translated, cut where no term is."""
    a = 0
    while a < len(raw):
        b = raw.find(b" ", min(a + size, len(raw)))
        b = len(raw) if b < 0 else b
        yield a, b
        a = b


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, the sum of their counts)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)


def coded_counts(column: pa.Array, code: Callable[[list[bytes]], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, text index, code, count), by text and code. `code` gives numbers below `width`, negative for
    terms that don't count. A long text is split window by window, so that memory follows its bytes and not its terms."""
    lengths, keys, counts = np.zeros(len(column), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, raw, at in blocks(column):
        text = raw.tobytes().translate(KEPT)
        if j - i == 1:
            parts = ([text[a:b].split()] for a, b in windows(text))
        else:
            parts = [[text[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]]
        for split in parts:
            each = np.array([len(words) for words in split])
            lengths[i:j] += each
            found = code([w for words in split for w in words] if len(split) > 1 else split[0])
            kept = found >= 0
            k, c = summed(np.repeat(np.arange(i, j), each)[kept] * width + found[kept])
            keys.append(k)
            counts.append(c)
    k, c = summed(np.concatenate(keys), np.concatenate(counts))
    return lengths, k // width, k % width, c


def lists(owner: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """A list array for each of `values`: those of each of the n owners, which ascend."""
    offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]
