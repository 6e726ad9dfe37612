"""Common prefixes of many short texts by backward extension on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

_PACKED = 7  # symbols of nine bits in one number


def _pack(symbols: np.ndarray) -> np.ndarray:
    """The first seven symbols at every place as one number; zeros beyond the end."""
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(_PACKED, dtype=np.int64)))
    packed = np.zeros(n, dtype=np.int64)
    for i in range(_PACKED):
        packed = (packed << 9) | padded[i : i + n]
    return packed


def suffix_order(packed: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first ``depth`` symbols or more, equal ones by place.

    Prefixes double; only places that are not alone yet are sorted again.
    """
    n = len(packed)
    order = np.argsort(packed, kind="stable")
    fresh = np.append(True, packed[order[1:]] != packed[order[:-1]])
    at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order], rank[n] = at, -1
    reach = _PACKED
    while reach < depth:
        alone = fresh & np.append(fresh[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        places = order[open_]
        key = rank[places] * (n + 1) + rank[np.minimum(places + reach, n)] + 1
        again = np.argsort(key, kind="stable")
        places, key = places[again], key[again]
        # Places keep their slots as a group; inside, they are in the new order.
        order[open_] = places
        fresh[open_] = np.append(True, key[1:] != key[:-1])
        at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order] = at
        reach *= 2
    return order


def shared_prefixes(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(group, text, offset)`` of every ``length``-byte string that occurs twice or more.

    Places of one string have one group.  Intervals of the transform start with the strings of seven
    bytes and are extended to the left by one byte at a time, breadth first; an interval of one
    suffix is dropped, and the search ends when the common prefixes reach ``length``.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    raw[ends] = 0  # no byte is zero now; what ends a text is
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    starts = ends - sizes
    left = ends[owner] - np.arange(len(raw))  # bytes from here to the end of the text

    packed = _pack(raw)
    suffixes = suffix_order(packed, length)
    transform = raw[suffixes - 1]
    transform[suffixes == 0] = 0
    back = np.empty(len(raw), dtype=np.int64)
    back[np.argsort(transform, kind="stable")] = np.arange(len(raw))

    def several(places: np.ndarray, fresh: np.ndarray):
        keep = ~(fresh & np.append(fresh[1:], True)) if len(fresh) else fresh
        return places[keep], np.cumsum(fresh)[keep] if len(fresh) else fresh.astype(np.int64)

    depth = min(_PACKED, length)
    first = packed[suffixes] >> (9 * (_PACKED - depth))
    active = np.flatnonzero(left[suffixes] >= depth)
    value = first[active]
    active, interval = several(active, np.append(True, value[1:] != value[:-1])[: len(active)])
    while depth < length and len(active):
        byte = transform[active]
        more = byte > 0  # a text does not extend beyond its start
        moved, parent, byte = back[active[more]], interval[more], byte[more]
        order = np.argsort(moved, kind="stable")
        active, parent, byte = moved[order], parent[order], byte[order]
        fresh = np.ones(len(active), dtype=bool)
        fresh[1:] = (parent[1:] != parent[:-1]) | (byte[1:] != byte[:-1])
        active, interval = several(active, fresh)
        depth += 1
    places = suffixes[active]
    return interval, owner[places], places - starts[owner[places]]
