"""Vectorised text kernels used inside tasks: tokens, hashes and shingles of Arrow batches.

Every function works on whole texts. A batch is walked in chunks of about
``CHUNK`` bytes, so that memory follows the chunk and not the batch; a text
longer than that makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Classes of bytes: 0 parts tokens, and a token holds bytes of one class.

#: Blank and \x09-\x0D part tokens.
SPACE = np.ones(256, dtype=np.uint8)
SPACE[[0x20, *range(0x09, 0x0E)]] = 0

#: Bytes (after lower-casing) that part words made of digits, letters and anything outside ASCII.
NON_WORD = np.ones(256, dtype=np.uint8)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    NON_WORD[_a : _b + 1] = 0

#: Runs of letters, digits and bytes outside ASCII are tokens, and so are runs of marks.
WORDS_AND_MARKS = SPACE * np.uint8(2)
WORDS_AND_MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INV):
        p = np.full(size, base, dtype=U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on every bit of the input."""
    h = h + U64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) if salt else h.copy()
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_chunks(column, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off_buf, data_buf = column.buffers()
    offs = np.frombuffer(off_buf, dtype=np.int64, count=n + 1, offset=column.offset * 8)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + size, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


class Tokens:
    """Tokens of a chunk: ``start`` and ``end`` byte positions, ``kind`` (class), ``doc`` (row in the chunk) and ``first`` (first token of each row, one more at the end)."""

    __slots__ = ("data", "doc", "end", "first", "kind", "start")

    def __init__(self, data: np.ndarray, offs: np.ndarray, classes: np.ndarray, lower: bool = True):
        data = LOWER[data] if lower else data
        n = len(data)
        kind = np.zeros(n + 2, dtype=np.uint8)
        kind[1:-1] = classes[data]
        own = kind[1:-1]
        begins = (own != 0) & (own != kind[:-2])
        ends = (own != 0) & (own != kind[2:])
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins[inner] = own[inner] != 0
        ends[inner - 1] = own[inner - 1] != 0
        self.data = data
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.kind = own[self.start]
        self.first = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each token's bytes, the same in every chunk."""
        n = len(self.data)
        size = max(2 * CHUNK, 1 << int(n + 1).bit_length())
        p, q = _powers(size)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * p[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * q[self.start] + (self.end - self.start).astype(U64))


def runs(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of ``k`` neighbouring values, one for each start at which ``k`` are left."""
    n = max(0, len(h) - k + 1)
    out = h[:n].copy()
    for i in range(1, k):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[i : n + i]
    return mix(out, salt + k)


def shingle_sets(words: Tokens, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its ``k``-word shingles); fewer words give the whole sequence as one, none give an empty set."""
    h = words.hashes()
    every = runs(h, k)
    for d in range(len(words.first) - 1):
        a, b = int(words.first[d]), int(words.first[d + 1])
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            yield d, s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield d, runs(h[a:b], b - a, 100)
        else:
            yield d, h[:0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Line feeds part lines; a text's lines are its runs of other bytes.
LINES = np.ones(256, dtype=np.uint8)
LINES[0x0A] = 0


def filled(t: Tokens) -> np.ndarray:
    """For each token, whether it holds a byte that is not white space."""
    seen = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(SPACE[t.data], out=seen[1:])
    return seen[t.end] > seen[t.start]


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run ``h[start:end]`` of values, whatever its length."""
    p, q = _powers(max(2 * CHUNK, 1 << int(len(h) + 1).bit_length()))
    sums = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(h * p[: len(h)], out=sums[1:])
    return mix((sums[end] - sums[start]) * q[start] + (end - start).astype(U64), 55)


def cut_ranges(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """``text`` without the byte ranges, which may overlap."""
    out, at = [], 0
    for a, b in sorted(ranges):
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    out.append(text[at:])
    return b"".join(out)
