"""Packed bitvectors with block popcount directories: rank and select for whole arrays of questions at once."""

from __future__ import annotations

import numpy as np

#: 64-bit words in a block; the directory has the ones before each block.
BLOCK = 8

#: Place of the k-th one (k from 0) in each byte.
IN_BYTE = np.array([[*(i for i in range(8) if b >> i & 1), *[8] * (8 - b.bit_count())] for b in range(256)], np.uint8)


def packed(mask: np.ndarray) -> np.ndarray:
    """The bits of mask as bytes, lowest bit first."""
    return np.packbits(mask, bitorder="little")


class Bits:
    """Bits of a byte buffer, which may be a memory map, and their directory."""

    def __init__(self, raw, invert: bool = False):
        raw = np.frombuffer(raw, np.uint8) if not isinstance(raw, np.ndarray) else raw
        whole = np.zeros(-(-max(len(raw), 1) // (8 * BLOCK)) * 8 * BLOCK, np.uint8)
        whole[: len(raw)] = raw
        self.words = (~whole if invert else whole).view("<u8").reshape(-1, BLOCK)
        ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        at = np.asarray(at, np.int64)
        block, bit = at // (64 * BLOCK), at % (64 * BLOCK)
        words = self.words[np.minimum(block, len(self.words) - 1)]
        left = np.clip(bit[:, None] - 64 * np.arange(BLOCK), 0, 64)
        mask = np.where(left == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(words & mask).sum(axis=1, dtype=np.int64)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The place of each one by its number (from 0); the numbers must be below total."""
        number = np.asarray(number, np.int64)
        if 8 * len(number) > self.total:  # then all places cost less than as many searches
            return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))[number]
        block = np.searchsorted(self.before, number, "right") - 1
        left = number - self.before[block]
        words = self.words[block]
        word, left = _step(np.bitwise_count(words), left)
        each = words[np.arange(len(word)), word].view(np.uint8).reshape(-1, 8)
        byte, left = _step(np.bitwise_count(each), left)
        return (block * BLOCK + word) * 64 + byte * 8 + IN_BYTE[each[np.arange(len(byte)), byte], left]


def _step(counts: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each row that holds the one of number left, and its number within the part."""
    ends = np.cumsum(counts, axis=1, dtype=np.uint16)  # at most the bits of a block
    part = (ends <= left.astype(np.uint16)[:, None]).sum(axis=1, dtype=np.uint8).astype(np.int64)
    rows = np.arange(len(part))
    return part, left - ends[rows, part] + counts[rows, part]
