"""Static three-wise binary fuse filters over 64-bit keys (Graf and Lemire, 2022), built with numpy."""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """Murmur3 finaliser of keys + seed, as unsigned 64-bit."""
    h = keys.astype(np.uint64) + np.uint64(seed & MASK)
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> np.uint64(33)
        h *= np.uint64(c)
    return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """A set of keys with no false negatives and about 2^-16 false positives, in about 18 bits a key."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three slots per key, in three neighbouring segments."""
        first = (h >> np.uint64(32)).astype(np.int64) * segments >> 32
        other, low = mix(h, 1), np.uint64(segment - 1)
        inside = [(other >> np.uint64(20 * i) & low).astype(np.int64) for i in range(3)]
        return np.stack([(first + i) * segment + x for i, x in enumerate(inside)])

    @staticmethod
    def print_of(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """Peel keys off slots that hold one key; another seed is tried when some are left."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
        segments = max(1, -(-int(n * room) // segment) - 2)
        for seed in range(1, 200):
            if seed % 20 == 0:
                segments += 1 + segments // 8
            h = mix(keys, seed * 0x9E3779B97F4A7C15)
            at = cls.slots(h, segment, segments)
            size = (segments + 2) * segment
            degree = np.bincount(at.ravel(), minlength=size)
            holds = np.zeros(size, np.int64)
            for row in at:
                np.bitwise_xor.at(holds, row, np.arange(n))
            order, left = [], n
            while left:
                alone = np.flatnonzero(degree == 1)
                if not len(alone):
                    break
                key, pick = np.unique(holds[alone], return_index=True)
                order.append((key, alone[pick]))
                for row in at:
                    np.subtract.at(degree, row[key], 1)
                    np.bitwise_xor.at(holds, row[key], key)
                left -= len(key)
            if left:
                continue
            prints = np.zeros(size, np.uint16)
            fp = cls.print_of(h)
            for key, slot in reversed(order):
                a, b, c = prints[at[0, key]], prints[at[1, key]], prints[at[2, key]]
                prints[slot] = fp[key] ^ a ^ b ^ c ^ prints[slot]
            return cls(seed, segment, segments, prints)
        raise RuntimeError("no seed gives a filter")

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        h = mix(keys, self.seed * 0x9E3779B97F4A7C15)
        a, b, c = self.slots(h, self.segment, self.segments)
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == self.print_of(h)

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<u4").tobytes() + self.prints.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse:
        seed, segment, segments = np.frombuffer(data, "<u4", 3).tolist()
        return cls(seed, segment, segments, np.frombuffer(data, "<u2", offset=12))
