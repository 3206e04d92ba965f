"""Elias-Fano encoding of a non-decreasing sequence, in numpy."""

from __future__ import annotations

import struct

import numpy as np

#: One select sample for so many set bits.
SAMPLE = 256
#: Values that are packed at once.
STRIP = 1 << 14
HEAD = struct.Struct("<QQqB")


def pack(values: np.ndarray, width: int) -> bytes:
    """Values of so many bits each, lowest bit first, end to end."""
    if not width or not len(values):
        return b""
    place, out = np.arange(width, dtype=np.uint64), []
    for at in range(0, len(values), STRIP):  # of a multiple of eight values, so of whole bytes
        bits = (values[at : at + STRIP, None] >> place) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: np.ndarray, width: int, at: int, n: int) -> np.ndarray:
    """n values from the one numbered at."""
    if not width or not n:
        return np.zeros(n, np.uint64)
    first, last = at * width, (at + n) * width
    bits = np.unpackbits(data[first // 8 : -(-last // 8)], bitorder="little")[first % 8 :][: n * width]
    return (bits.reshape(n, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)


class EliasFano:
    """n values of the range from base to base + universe in about n * (2 + log2(universe / n)) bits.

    The low bits of each value stand in one array, the high bits as gaps in unary in another; a select sample for each
    SAMPLE values, 32 bits wide, makes any value a short scan away.
    """

    def __init__(self, n: int, universe: int, base: int, low: int, low_bits, high_bits, samples):
        self.n, self.universe, self.base, self.low = n, universe, base, low
        self.low_bits, self.high_bits, self.samples = low_bits, high_bits, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        base = int(values[0])
        x = values.astype(np.int64).astype(np.uint64) - np.uint64(base % 2**64)
        universe = int(x[-1])
        low = max(0, (universe // n).bit_length() - 1) if universe else 0
        ones = ((x >> np.uint64(low)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        low_bits = np.frombuffer(pack(x & np.uint64((1 << low) - 1), low), np.uint8)
        return cls(n, universe, base, low, low_bits, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return HEAD.pack(self.n, self.universe, self.base, self.low) + b"".join(
            struct.pack("<Q", len(p)) + p for p in (self.low_bits.tobytes(), self.high_bits.tobytes(), self.samples.tobytes())
        )

    @classmethod
    def from_buffer(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that starts there, and where it ends."""
        n, universe, base, low = HEAD.unpack_from(data, at)
        at += HEAD.size
        parts = []
        for kind in (np.uint8, np.uint8, "<u4"):
            (size,) = struct.unpack_from("<Q", data, at)
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at + 8))
            at += 8 + size
        return cls(n, universe, base, low, *parts), at

    def select(self, i: int) -> int:
        """Position of the set bit numbered i among the high bits: from the sample before it, by bytes, then by bits."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        while True:
            chunk = np.unpackbits(self.high_bits[byte : byte + 64], bitorder="little")
            if byte == at // 8:
                chunk[: at % 8] = 0
            ones = np.flatnonzero(chunk)
            if left < len(ones):
                return byte * 8 + int(ones[left])
            left -= len(ones)
            byte += 64

    def select_run(self, a: int, b: int) -> np.ndarray:
        """Positions of the set bits numbered a to b - 1: only the bits between their samples are read."""
        first, last = a // SAMPLE, -(-b // SAMPLE)
        start = int(self.samples[first])
        end = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.high_bits)
        bits = np.unpackbits(self.high_bits[start // 8 : -(-end // 8)], bitorder="little")
        bits[: start % 8] = 0
        return start // 8 * 8 + np.flatnonzero(bits)[a - first * SAMPLE : b - first * SAMPLE]

    def run(self, a: int, b: int) -> np.ndarray:
        """The values numbered a to b - 1, by select."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.zeros(0, np.int64)
        high = (self.select_run(a, b) - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low)
        return ((high | unpack(self.low_bits, self.low, a, b - a)) + np.uint64(self.base % 2**64)).astype(np.int64)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return self.base + ((self.select(i) - i) << self.low | int(unpack(self.low_bits, self.low, i, 1)[0]))

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high_bits, bitorder="little"))[: self.n].astype(np.uint64)
        x = ((ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low)) | unpack(self.low_bits, self.low, 0, self.n)
        return (x + np.uint64(self.base % 2**64)).astype(np.int64)
