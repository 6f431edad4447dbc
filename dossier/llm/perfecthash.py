"""A minimal perfect hash over 64-bit keys, in NumPy: levels of bitmaps (keys
that collide at a level fall to the next), with ranks for the slots."""

from __future__ import annotations

import io

import numpy as np

GAMMA = 2  # bits of a level per key that reaches it
BLOCK = 512  # bits per rank entry


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, seeded by level."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """slots(keys): for the n distinct keys it was built from, each of 0..n-1
    once; for other keys -1 or any slot."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.bits = [np.unpackbits(x, bitorder="little") for x in levels]
        self.starts = np.concatenate(([0], np.cumsum([int(b.sum()) for b in self.bits])))
        self.ranks = [np.concatenate(([0], np.cumsum(b.reshape(-1, BLOCK).sum(1, dtype=np.int64))[:-1])) if len(b) else np.zeros(0, np.int64) for b in self.bits]
        self.within = [(np.cumsum(b.reshape(-1, BLOCK), 1, dtype=np.uint16) - b.reshape(-1, BLOCK)).ravel() if len(b) else b for b in self.bits]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys.astype(np.uint64))
        while len(left):
            size = max(BLOCK, -(-GAMMA * len(left) // BLOCK) * BLOCK)
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for k, bits in enumerate(self.bits):
            if not len(open_):
                break
            at = (mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            place = at[hit]
            out[open_[hit]] = self.starts[k] + self.ranks[k][place // BLOCK] + self.within[k][place]
            open_ = open_[~hit]
        return out


class LineIndex:
    """Arrays by slot: fingerprint (the second half of a line's 128-bit hash),
    number of documents, largest doc_id."""

    def __init__(self, hashes: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.hashes, self.prints, self.counts, self.last = hashes, prints, counts, last

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineIndex:
        # Two lines whose first halves are equal would share a slot: fold the second half in until none do.
        hashes = PerfectHash.build(_fold(keys, prints))
        slots = hashes.slots(_fold(keys, prints))
        if len(np.unique(slots)) != len(slots):
            raise ValueError("keys of a shard must be distinct")
        out = cls(hashes, *(np.empty_like(x) for x in (prints, counts, last)))
        out.prints[slots], out.counts[slots], out.last[slots] = prints, counts, last
        return out

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, slot): a stranger's slot is exposed by its fingerprint."""
        if not len(self.prints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        slots = self.hashes.slots(_fold(keys, prints))
        found = (slots >= 0) & (self.prints[slots] == prints)
        return found, slots

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, prints=self.prints, counts=self.counts, last=self.last, **{f"level{k}": x for k, x in enumerate(self.hashes.levels)})
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> LineIndex:
        z = np.load(io.BytesIO(blob))
        levels = [z[f"level{k}"] for k in range(sum(x.startswith("level") for x in z.files))]
        return cls(PerfectHash(levels), z["prints"], z["counts"], z["last"])


def _fold(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return keys ^ (prints * np.uint64(0x9E3779B97F4A7C15))
