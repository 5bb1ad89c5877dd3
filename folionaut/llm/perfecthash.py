"""A minimal perfect hash over distinct fixed-width digests, built level by level with numpy.

Each level hashes the digests still without a slot into a bit field somewhat larger than their number; a position that
exactly one digest hits is that digest's, the others go on to the next level. The slot of a digest is the number of bits
set before its own, over all levels, so ``n`` digests have the slots ``0 .. n - 1``. A digest that is no member may reach
some slot as well: whoever looks up compares the whole digest kept there.
"""

from __future__ import annotations

import numpy as np

from folionaut.llm.arrays import mix

#: Positions of a level for each digest that reaches it, and levels at most; what is then left is searched in order.
SPACE_PER_KEY = 1.6
LEVELS = 40

_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)


def digest_matrix(packed: bytes | np.ndarray, width: int) -> np.ndarray:
    """Digests of ``width`` bytes, one per row."""
    return np.frombuffer(packed, dtype=np.uint8).reshape(-1, width)


def _lanes(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each digest, of its first and its last eight bytes."""
    head = np.ascontiguousarray(digests[:, :8]).view(np.uint64).ravel()
    tail = np.ascontiguousarray(digests[:, -8:]).view(np.uint64).ravel()
    return head, tail


def _position(head: np.ndarray, tail: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (mix(head + mix(tail ^ salt)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots of ``n`` distinct digests of ``width`` bytes, at least eight."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray, width: int):
        self.sizes, self.bits, self.rest, self.width = sizes, bits, rest, width
        self.begin = np.append(0, np.cumsum((sizes + 7) // 8))
        # Bits set before each byte.
        self.rank = np.append(0, np.cumsum(_BITS[bits]))

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        """From distinct digests, one per row."""
        head, tail = _lanes(digests)
        left = np.arange(len(digests))
        sizes, fields = [], []
        while len(left) and len(sizes) < LEVELS:
            size = max(64, int(len(left) * SPACE_PER_KEY))
            at = _position(head[left], tail[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            fields.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = left[~alone[at]]
        rest = digests[left]
        rest = rest[np.argsort(np.ascontiguousarray(rest).view(f"S{digests.shape[1]}").ravel())] if len(rest) else rest
        bits = np.concatenate(fields) if fields else np.empty(0, dtype=np.uint8)
        return cls(np.array(sizes, dtype=np.int64), bits, rest, digests.shape[1])

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest if it is a member; else any slot, or -1."""
        out = np.full(len(digests), -1, dtype=np.int64)
        head, tail = _lanes(digests)
        open_ = np.arange(len(digests))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                return out
            at = _position(head[open_], tail[open_], level, size)
            byte = self.begin[level] + (at >> 3)
            bit = at & 7
            hit = (self.bits[byte] >> bit.astype(np.uint8)) & 1 == 1
            below = _BITS[self.bits[byte] & ((1 << bit) - 1).astype(np.uint8)]
            out[open_[hit]] = (self.rank[byte] + below)[hit]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            whole = {d.tobytes(): i for i, d in enumerate(self.rest)}
            out[open_] = [self.rank[-1] + whole[k] if (k := digests[i].tobytes()) in whole else -1 for i in open_]
        return out

    def dump(self) -> tuple[bytes, bytes, bytes]:
        return self.sizes.tobytes(), self.bits.tobytes(), np.ascontiguousarray(self.rest).tobytes()

    @classmethod
    def load(cls, sizes: bytes, bits: bytes, rest: bytes, width: int) -> PerfectHash:
        return cls(np.frombuffer(sizes, dtype=np.int64), np.frombuffer(bits, dtype=np.uint8), digest_matrix(rest, width), width)
