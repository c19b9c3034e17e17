"""Elias-Fano codes of non-decreasing integers.

``n`` values below ``u`` take about ``2 + log2(u / n)`` bits each: the low
bits are packed, the high bits are written in unary into a bit vector.  A
sample of every 64th one-bit gives ``select`` without a table of offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SAMPLE = 64


@dataclass
class EliasFano:
    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes  # position of every SAMPLE-th one, unsigned 32-bit

    @staticmethod
    def encode(values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if n == 0:
            return EliasFano(0, 0, b"", b"", b"")
        universe = int(values[-1]) + 1
        low_bits = max(0, (universe // n).bit_length() - 1)
        shift = np.uint64(low_bits)
        ones = (values >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        bits[ones] = 1
        cols = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(cols.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return EliasFano(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(),
                         ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        raw = int.from_bytes(self.low[at // 8:(at + self.low_bits + 7) // 8], "little")
        return (raw >> (at % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: jump to the nearest sampled one-bit, then count bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = i // SAMPLE
        at = int.from_bytes(self.samples[4 * k:4 * k + 4], "little")
        left = i - k * SAMPLE
        byte, bit = divmod(at, 8)
        word = self.high[byte] >> bit << bit
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        position = 8 * byte + (word & -word).bit_length() - 1
        return ((position - i) << self.low_bits) | self._low(i)

    def decode(self) -> np.ndarray:
        """All values."""
        if self.n == 0:
            return np.empty(0, dtype=np.int64)
        bits = np.unpackbits(np.frombuffer(self.high, dtype=np.uint8), bitorder="little")
        high = np.flatnonzero(bits)[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high
        low = np.unpackbits(np.frombuffer(self.low, dtype=np.uint8), bitorder="little")
        low = low[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (high << self.low_bits) | (low << np.arange(self.low_bits)).sum(axis=1)
