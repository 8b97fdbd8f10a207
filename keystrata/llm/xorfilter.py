"""Immutable fingerprint filters built by peeling a random 3-partite hypergraph, in numpy."""

from __future__ import annotations

import numpy as np

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class XorFilter:
    """Says of every key it was built from "maybe", of another "no", or "maybe" at a rate of 2^-fingerprint bits.

    Built once from distinct 64-bit hashes and never changed.  Each key is an edge between one slot of each of
    three segments; slots with one edge are peeled off, all of a round at once, until none is left, and the
    fingerprints are assigned in reverse order, so that the exclusive or of a key's three slots is its fingerprint.
    """

    def __init__(self, seed: int, segment: int, slots: np.ndarray):
        self.seed, self.segment, self.slots = seed, segment, slots

    @property
    def false_rate(self) -> float:
        return 2.0 ** -(8 * self.slots.dtype.itemsize) if len(self.slots) else 0.0

    @staticmethod
    def _places(hashes: np.ndarray, seed: int, segment: int) -> tuple[np.ndarray, np.ndarray]:
        mixed = _mix(hashes + np.uint64(seed) * _GOLD)
        # 21 bits of the mixed hash choose within each segment; 32 further bits of a second mix are the fingerprint
        wide = np.uint64(segment)
        mask = np.uint64(0x1FFFFF)
        places = np.empty((3, len(hashes)), np.int64)
        for i in range(3):
            places[i] = ((((mixed >> np.uint64(21 * i)) & mask) * wide) >> np.uint64(21)).astype(np.int64) + i * segment
        return places, (_mix(mixed ^ _GOLD) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def build(cls, hashes: np.ndarray, fingerprint: type = np.uint16) -> "XorFilter":
        hashes = np.unique(np.ascontiguousarray(hashes).view(np.uint64))
        n = len(hashes)
        if not n:
            return cls(0, 0, np.zeros(0, fingerprint))
        if n > 1 << 20:
            raise ValueError("shard the keys: a filter holds up to 2^20")
        segment = int(1.23 * n / 3) + 12
        with np.errstate(over="ignore"):
            for seed in range(1, 200):
                places, prints = cls._places(hashes, seed, segment)
                rounds = cls._peel(places, 3 * segment, n)
                if rounds is not None:
                    break
                if seed % 20 == 0:
                    segment = int(segment * 1.05) + 8
            else:
                raise RuntimeError("no seed peels")
        prints = prints.astype(fingerprint)
        slots = np.zeros(3 * segment, fingerprint)
        for edges, own in reversed(rounds):
            p = places[:, edges]
            # a round's slots are distinct and none is another slot of an edge of the same or a later round
            slots[own] = 0
            slots[own] = prints[edges] ^ slots[p[0]] ^ slots[p[1]] ^ slots[p[2]]
        return cls(seed, segment, slots)

    @staticmethod
    def _peel(places: np.ndarray, size: int, n: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (edges, the slot each is peeled at), or None if a core is left.

        Of each slot only the degree and the exclusive or of its edges are kept.
        """
        degree = np.bincount(places.ravel(), minlength=size)
        edges = np.arange(n, dtype=np.int64)
        folded = np.zeros(size, np.int64)
        for i in range(3):
            np.bitwise_xor.at(folded, places[i], edges)
        rounds, left = [], n
        candidates = np.flatnonzero(degree == 1)
        while len(candidates):
            peeled, at = np.unique(folded[candidates], return_index=True)
            rounds.append((peeled, candidates[at]))
            left -= len(peeled)
            touched = places[:, peeled]
            for i in range(3):
                np.subtract.at(degree, touched[i], 1)
                np.bitwise_xor.at(folded, touched[i], peeled)
            near = np.unique(touched)
            candidates = near[degree[near] == 1]
        return rounds if not left else None

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.slots):
            return np.zeros(len(hashes), bool)
        with np.errstate(over="ignore"):
            places, prints = self._places(np.ascontiguousarray(hashes).view(np.uint64), self.seed, self.segment)
        found = self.slots[places[0]] ^ self.slots[places[1]] ^ self.slots[places[2]]
        return found == prints.astype(self.slots.dtype)

    def to_bytes(self) -> bytes:
        head = np.array([self.seed, self.segment, self.slots.dtype.itemsize], np.int64)
        return head.tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "XorFilter":
        seed, segment, width = np.frombuffer(data[:24], np.int64)
        kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[int(width)]
        return cls(int(seed), int(segment), np.frombuffer(data[24:], kind))
