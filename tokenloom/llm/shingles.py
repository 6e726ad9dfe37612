"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
_CHUNK_BYTES = 512 * 1024

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _random.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_JOIN = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(64, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    """The first ``n`` powers of the step."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate(
            ([np.uint64(1)], np.cumprod(np.full(2 * n, _STEP, dtype=np.uint64)))
        )
    return _powers[:n]


_power(4096)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of ``data``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    before = np.empty(len(raw), dtype=bool)
    before[:1] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(before & ~space)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    ends = np.append(starts[1:], len(raw))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, ends - starts)
    tail = raw[starts[0] :]
    terms = _BYTES[tail] * _power(int(place.max()) + 1)[place]
    terms[space[starts[0] :]] = 0
    return starts, mix(np.add.reduceat(terms, starts - starts[0]))


def _of_words(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles of one text; the whole text if it has fewer words."""
    n = len(words)
    if n == 0:
        return words
    length = min(width, n)
    total = np.full(n - length + 1, length, dtype=np.uint64)
    for i in range(length):
        total = total * _JOIN + words[i : n - length + 1 + i]
    return np.unique(mix(total))


def arrow_bytes(column) -> Iterator[bytes | None]:
    """The texts of an Arrow column, one at a time."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else None


def shingle_sets(texts, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Per text (UTF-8 bytes or str) the sorted distinct 64-bit hashes of its
    shingles, none for null.  A few texts are held at a time."""
    pending: list[bytes] = []
    size = 0

    def run():
        data = b" ".join(pending)
        starts, hashes = word_hashes(data)
        bounds = np.cumsum([0] + [len(t) + 1 for t in pending])
        cuts = np.searchsorted(starts, bounds)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _of_words(hashes[a:b], width)

    for text in texts:
        # Lower-cases A-Z only.
        if isinstance(text, str):
            text = text.encode("utf-8", "surrogatepass")
        pending.append(b"" if text is None else text.lower())
        size += len(pending[-1])
        if size > _CHUNK_BYTES:
            yield from run()
            pending, size = [], 0
    if pending:
        yield from run()
