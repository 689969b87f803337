"""Words of whole text batches as numpy arrays.

A word is a run of bytes other than space and tab to carriage return, so no word ever splits a code
point. Texts stay in Arrow's UTF-8 buffer; nothing loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE_BYTES = 2_000_000

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Texts:
    """UTF-8 bytes of consecutive texts: ``buf`` and the ``offs`` of each text (one more than texts)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        self.n = len(offs) - 1

    def text(self, i: int) -> str:
        return self.buf[self.offs[i]:self.offs[i + 1]].tobytes().decode("utf-8", "replace")


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(first row, texts) of runs of rows of at most ``limit`` bytes; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, Texts(buf[offs[first]:offs[last]], offs[first:last + 1] - offs[first])
        first = last


class Words:
    """Words of ``texts``: byte ``start`` and ``end``, index of their text, 64-bit digests."""

    def __init__(self, texts: Texts, lower: bool = False):
        buf, offs = texts.buf, texts.offs
        self.texts = texts
        self.bytes = LOWER[buf] if lower else buf
        inside = ~SEPARATOR[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True
        before = np.empty(len(buf), bool)
        if len(buf):
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (edge[:-1] | ~before))
        after = np.empty(len(buf), bool)
        if len(buf):
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
        self.inside = inside
        self.first = np.searchsorted(self.start, offs)  # of each text, and the total
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(texts.n), self.count)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Digest of the bytes from ``start`` to ``end``."""
        if self._sums is None:
            self._sums = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum(_BYTES[self.bytes] * powers(_BASE, len(self.bytes)), out=self._sums[1:])
            self._back = powers(_INVERSE, len(self.bytes) + 1)
        h = (self._sums[end] - self._sums[start]) * self._back[start]
        return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))

    def hashes(self) -> np.ndarray:
        return self.digest(self.start, self.end)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one for each byte) in each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.texts.offs])

    def word(self, i: int) -> str:
        return self.bytes[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all windows of ``k`` words that stay in one text, and where they begin."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out = mix(out + h[at + i] + np.uint64(i + 1)) if i else mix(h[at])
    return out, at


def repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of the digests occur twice or more in their own text."""
    if not len(h):
        return np.zeros(0, bool)
    key = mix(h + doc.astype(np.uint64) * _BASE)
    order = np.argsort(key)
    s = key[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same
    return out


def covered(begin: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, begin, 1)
    np.add.at(d, begin + length, -1)
    return np.cumsum(d[:-1]) > 0
