"""Vectorised word scanning of Arrow string columns (used inside Spark tasks).

A batch of texts is cut into chunks of a few MB on row boundaries; inside a
chunk all words of all texts are found with array operations over the UTF-8
bytes, and every word gets a 64-bit hash of its bytes.  Nothing here keeps
state between batches, so memory is bounded by one chunk (or by the longest
single text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: every byte but the space and \t \n \v \f \r
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: digits, a-z and every byte of a character outside ASCII
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for key, base in (("p", _MULT), ("i", inverse)):
            seq = np.full(size, base, dtype=np.uint64)
            seq[0] = 1
            _POWERS[key] = np.cumprod(seq, dtype=np.uint64)
    out = _POWERS["p"][:n], _POWERS["i"][:n]
    if n > 4 * CHUNK_BYTES:  # a very long text: don't keep its tables
        _POWERS.clear()
    return out


@dataclass
class Words:
    """Words of ``n_rows`` consecutive texts: byte spans, 64-bit hashes, text index."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray  # n_rows + 1 offsets into the word arrays
    offsets: np.ndarray  # n_rows + 1 byte offsets of the texts
    n_rows: int

    def text(self, i: int, j: int) -> bytes:
        """Words i..j-1 joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j]))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word index, hash) of every run of ``k`` words inside one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1:])
        h = np.full(len(at), k, dtype=np.uint64)
        for j in range(k):
            h = h * _MULT + self.hash[at + j]
        return at, mix(h)


def scan(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Find the words of the texts ``data[offsets[i]:offsets[i+1]]`` (A-Z lower-cased)."""
    offsets = offsets - offsets[0]
    n_rows = len(offsets) - 1
    data = LOWER[data]
    w = is_word[data]
    n = len(data)
    begins = w.copy()
    begins[1:] &= ~w[:-1]
    ends = w.copy()
    ends[:-1] &= ~w[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]  # neighbours in the buffer are different texts
    begins[cut] |= w[cut]
    ends[cut - 1] |= w[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers(n)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=prefix[1:])
    h = mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * _MIX1)
    first = np.searchsorted(start, offsets)
    first[-1] = len(start)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    return Words(data, start, end, h, row, first, offsets, n_rows)


def chunks(column: pa.Array, is_word: np.ndarray) -> Iterator[tuple[int, Words]]:
    """(index of the first row, words) for chunks of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        j = min(j, len(column))
        yield i, scan(data[offsets[i]:offsets[j]], offsets[i:j + 1], is_word)
        i = j
