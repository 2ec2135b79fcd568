"""Array helpers for text inside tasks: rows of an Arrow batch as one byte buffer, words, substring hashes.

A substring hash is a polynomial over random byte values modulo 2^64 taken from prefix sums, so the hash of
any substring of a buffer costs O(1) after one pass, independent of where the buffer puts the substring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: The white space that separates words in the word-based operators (space and 0x09–0x0D).
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a token made of letters and digits (every byte of a non-ASCII character counts as a letter).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, b in ((0, _BASE), (1, _BASE_INV)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    p = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(len(buf) + 1)[0][:len(buf)], out=p[1:])
    return p


def substring_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end] from the prefix sums of buf; equal strings have equal hashes in any buffer."""
    inv = _powers(len(p))[1]
    return mix((p[end] - p[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_blocks(column: pa.Array, max_bytes: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) for runs of rows of about ``max_bytes``; null counts as empty.

    A row longer than that is a run of its own: texts are never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def spans(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``member`` that don't cross row offsets: starts, ends, first run of each row (and the end)."""
    n = len(member)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = member[:-1]
    start = np.flatnonzero(member & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = member[1:]
    end = np.flatnonzero(member & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def words(buf: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and each row's first word for the rows of one block."""
    return spans(~separators[buf], off)


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))
