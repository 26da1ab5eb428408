"""Suffix arrays by Larsson-Sadakane refinement and Kasai's common prefixes, on whole numpy arrays."""

from __future__ import annotations

import numpy as np


#: Suffixes that one sort of a refinement takes; their keys stay in a core's cache.
SORT_ROWS = 1 << 17


def suffix_array(s: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``s`` and each suffix's rank.

    Groups of suffixes that agree so far are sorted by the rank of what follows; the compared length
    doubles each round and sorted groups are left alone. With ``depth``, suffixes that agree in that
    many symbols stay in the order of their places, with one rank; all others are told apart.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Numbers of places take half the memory where they fit.
    place = np.int32 if n < 1 << 31 else np.int64
    below = n.bit_length()
    h, key = packed_start(s, 62 - below, depth)
    if h >= min(4, depth or 4):
        # The place in the lower bits makes a sort of numbers do, and keeps equal ones in order.
        key <<= below
        key |= np.arange(n)
        key.sort()
        sa, sorted_key = (key & ((1 << below) - 1)).astype(place), key >> below
    else:
        h, key = packed_start(s, most=depth)
        sa = np.argsort(key, kind="stable").astype(place)
        sorted_key = key[sa]
    rank = np.empty(n + 1, place)
    rank[n] = -1
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.flatnonzero(new).astype(place)
    rank[sa] = np.repeat(head, np.diff(np.append(head, n)))
    open_at, new = still_open(new, np.arange(n, dtype=place))
    while len(open_at) and (depth is None or h < depth):
        # Ranks of the same length, nearer by what the depth leaves out, end at the depth.
        step = h if depth is None else min(h, depth - h)
        suffix = sa[open_at]
        follow = rank[np.minimum(suffix + place(min(step, n)), n)]
        order, new = refined(new, follow, n)
        suffix = suffix[order]
        sa[open_at] = suffix
        head = np.flatnonzero(new)
        rank[suffix] = np.repeat(open_at[head], np.diff(np.append(head, len(suffix))))
        open_at, new = still_open(new, open_at)
        h += step
    return sa, rank[:n]


def refined(first: np.ndarray, follow: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of each group by ``follow`` (-1 to n - 1), and marks of where group or follow change in it; ``first`` marks group heads.

    Groups are sorted in portions of about SORT_ROWS, by numbers that hold group, follow and place.
    """
    size = len(first)
    order, new = np.empty(size, follow.dtype), np.ones(size, bool)
    heads = np.flatnonzero(first)
    cuts = np.unique(np.append(heads[np.minimum(np.searchsorted(heads, np.arange(0, size, SORT_ROWS)), len(heads) - 1)], size))
    width = n.bit_length()
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        below = (hi - lo).bit_length()
        key = np.cumsum(first[lo:hi])
        if int(key[-1]).bit_length() + width + below <= 63:
            key <<= width
            key += follow[lo:hi] + 1
            key <<= below
            key |= np.arange(hi - lo)
            key.sort()
            order[lo:hi] = (key & ((1 << below) - 1)) + lo
            key >>= below
        else:
            key = key * (n + 1) + (follow[lo:hi] + 1)
            own = np.argsort(key, kind="stable")
            key, order[lo:hi] = key[own], own + lo
        new[lo + 1 : hi] = key[1:] != key[:-1]
    return order, new


def packed_start(s: np.ndarray, room: int = 62, most: int | None = None) -> tuple[int, np.ndarray]:
    """As many leading symbols as fit ``room`` bits (``most`` at most), as one number for each suffix, and how many they are.

    Symbols are numbered densely first. The end of the text counts as a symbol below all others.
    """
    known = np.flatnonzero(np.bincount(s))
    number = np.zeros(int(known[-1]) + 1, np.int64)
    number[known] = np.arange(1, len(known) + 1)
    symbol = np.append(number[s], 0)
    bits = len(known).bit_length()
    width = max(1, min(room // bits, most or room))
    key = symbol[:-1].copy()
    for h in range(1, width):
        key <<= bits
        key[: len(s) - h] |= symbol[h:-1] if h < len(s) else 0
    return width, key


def still_open(new: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose group has more than one member, and their marks; ``new`` marks group heads."""
    open_at = ~new
    open_at[:-1] |= open_at[1:]
    return places[open_at], new[open_at]


def common_prefixes(s: np.ndarray, sa: np.ndarray, cap: int, stride: int = 32, rank: np.ndarray | None = None) -> np.ndarray:
    """Kasai's array: symbols (``cap`` at most) that each suffix shares with the one before it in ``sa``.

    Kasai's bound says that the next text position shares at most one symbol fewer with its own
    predecessor. Every ``stride``-th position is compared from nothing, all of them at once; then the
    positions between advance together, each from what its left neighbour leaves it. A word of eight
    bytes is compared at a time.

    ``rank`` is that of a ``suffix_array`` of depth ``cap``: suffixes of one rank share ``cap`` symbols. As
    their order is left open, the position after one that has its predecessor's rank is compared from nothing.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int32)
    kind = np.dtype(np.min_scalar_type(int(s.max())))
    each = 8 // kind.itemsize
    rows = -(-n // stride)
    padded = np.zeros(n + cap + 2 * each, kind)
    padded[:n] = s
    word = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded[:each].view("<u8"), (n + cap + each,), (kind.itemsize,), writeable=False))
    # Position k of every stretch of ``stride`` is in row k; cap: shared already, -1: nothing before.
    before = np.full(rows * stride, -1, sa.dtype)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(rows * stride, np.int32)
    if rank is not None:
        own = rank[sa]
        plcp[sa[1:][own[1:] == own[:-1]]] = cap
    before, plcp = np.ascontiguousarray(before.reshape(rows, stride).T), np.ascontiguousarray(plcp.reshape(rows, stride).T)
    left = np.zeros(rows, np.int32)
    for k in range(stride):
        tied = plcp[k] == cap
        at = np.flatnonzero((before[k] >= 0) & ~tied)
        a, b, g = at * stride + k, before[k][at].astype(np.int64), left[at]
        most = np.minimum(cap, n - np.maximum(a, b)).astype(np.int32)
        got = most.copy()
        live = None
        while len(a):
            differ = word[a + g] ^ word[b + g]
            apart = differ != 0
            where = np.flatnonzero(apart) if live is None else live[apart]
            # As many low bits as the lowest that differs has below it: whole symbols agree in them.
            g[apart] += (np.bitwise_count((differ[apart] - np.uint64(1)) & ~differ[apart]) >> 3) // kind.itemsize
            got[where] = g[apart]
            on = np.flatnonzero(~apart & (g + each < (most if live is None else most[live])))
            live = on if live is None else live[on]
            a, b, g = a[on], b[on], g[on] + np.int32(each)
        plcp[k][at] = np.minimum(got, most)
        left = np.where(tied, 0, np.maximum(plcp[k] - 1, 0)).astype(np.int32) if rank is not None else np.maximum(plcp[k] - 1, 0)
    lcp = plcp.T.reshape(-1)[sa]
    lcp[0] = 0
    return lcp
