"""Elias-Fano coding of ascending numbers, with a select structure.

A number's ``low_bits`` low bits lie in an array of that width; its high part is a one-bit at
position ``high + rank`` of a bit vector. Every ``SAMPLE``-th one-bit's position is kept, so select
scans a bounded piece of the vector. For n numbers below u this takes about n * (2 + log2(u / n)) bits.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 256


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if n and (v[1:] < v[:-1]).any():
            raise ValueError("the numbers must ascend")
        top = int(v[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        # low bits: each number's in little-endian bit order, end to end
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little")
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros((int(at[-1]) + 1) if n else 0, np.uint8)
        vector[at] = 1
        return cls(n, bits, low, np.packbits(vector, bitorder="little"), at[::SAMPLE].astype(np.uint64))

    def select(self, i: int) -> int:
        """The i-th number, from 0: its one-bit is sought from the last sample at or before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        sample, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = sample // 8
        skip = sample % 8
        need = rest
        while True:
            bits = np.unpackbits(self.high[byte : byte + 128], bitorder="little")
            ones = np.flatnonzero(bits[skip:]) + skip
            if need < len(ones):
                at = byte * 8 + int(ones[need])
                break
            need -= len(ones)
            byte, skip = byte + 128, 0
        return (at - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        byte, off = divmod(first, 8)
        span = (off + self.low_bits + 7) // 8
        return int.from_bytes(self.low[byte : byte + span].tobytes(), "little") >> off & ((1 << self.low_bits) - 1)

    def select_all(self) -> np.ndarray:
        """Every number in turn."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        out = (at - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if self.low_bits:
            low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
            out |= (low << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def tobytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], np.uint64)
        return head.tobytes() + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> EliasFano:
        n, bits, n_low, n_high, n_samples = (int(x) for x in np.frombuffer(data, np.uint64, 5))
        at = 40
        samples = np.frombuffer(data, np.uint64, n_samples, at)
        at += 8 * n_samples
        low = np.frombuffer(data, np.uint8, n_low, at)
        return cls(n, bits, low, np.frombuffer(data, np.uint8, n_high, at + n_low), samples)
