"""Minimal perfect hashing of 64-bit keys in blocks of bounded size.

A key is mixed by a permutation of the 64-bit numbers, so distinct keys never have equal hashes.
The hash names the block.  Inside, levels of bits place the keys: a key that is alone on its bit
stays there, the others go on to the next, smaller level.  The rank of its bit is the key's slot,
so ``n`` keys have the slots 0 to n - 1 and a look-up costs a few bits, whatever ``n`` is.
"""

from __future__ import annotations

import numpy as np

_GAMMA = 2
_U = np.uint64
# The public splitmix64 finaliser and its increment.
_STEP, _A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mixed(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(_U) + _STEP * _U(seed + 1)
        z = (z ^ (z >> _U(30))) * _A
        z = (z ^ (z >> _U(27))) * _B
        return z ^ (z >> _U(31))


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each hash, by its upper half."""
    return ((hashes >> _U(32)) * _U(blocks) >> _U(32)).astype(np.int64)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """32 bits that do not follow from the block."""
    return (mixed(hashes.view(np.int64), 99) & _U(0xFFFFFFFF)).astype(np.uint32)


def _bits(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(hashes.view(np.int64), level) % _U(size)).astype(np.int64)


def build(hashes: np.ndarray) -> list[np.ndarray]:
    """The levels of distinct ``hashes``: arrays of booleans."""
    levels, left = [], hashes
    while len(left):
        size = max(64, -(-len(left) * _GAMMA // 64) * 64)
        at = _bits(left, len(levels), size)
        held = np.bincount(at, minlength=size)
        levels.append(held == 1)
        left = left[held[at] > 1]
        if len(levels) > 200:
            raise ValueError("keys of a block are not distinct")
    return levels


def slots(levels: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """The slot of each hash; of a hash that was not among those built, -1 or anything."""
    found = np.full(len(hashes), -1, dtype=np.int64)
    open_, before = np.arange(len(hashes)), 0
    for level, bits in enumerate(levels):
        at = _bits(hashes[open_], level, len(bits))
        rank = np.cumsum(bits) - 1
        hit = bits[at]
        found[open_[hit]] = before + rank[at[hit]]
        before += int(rank[-1]) + 1
        open_ = open_[~hit]
    return found
