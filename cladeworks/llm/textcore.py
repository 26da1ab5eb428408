"""Vectorised words, hashes and shingles over the bytes of many texts at once.

Words are judged on bytes. Both word classes in use keep every non-ASCII character whole, so bytes
from 0x80 always belong to a word and the result equals the regular expression over code points.
"""

from __future__ import annotations

import numpy as np

_BYTE = np.arange(256)
#: A-Z to a-z, all else as it is.
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, after lower-casing.
ALNUM = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
#: ``[^\x20\x09-\x0D]``.
SOLID = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))

_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash multiplier and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        both = []
        for base in (_MUL, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = both[0], both[1]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the number of the first word (len + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    edge[first] = inside[first]
    starts = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:]
    edge[last] = inside[last]
    ends = np.flatnonzero(edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, section: int = 1 << 21) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order, by prefix sums of a polynomial hash."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(int(np.searchsorted(ends, base + section, "right")), i + 1)
        top = int(ends[j - 1])
        up, down = powers(top - base + 1)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles within each text, and each shingle's text.

    A text of fewer words, but not none, has its whole sequence as its only shingle.
    """
    counts = np.diff(first)
    doc_of = np.repeat(np.arange(len(counts)), counts)
    if len(words) >= n:
        value = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            value = value * np.uint64(0xFF51AFD7ED558CCD) + words[k : len(words) - n + 1 + k]
        whole = doc_of[: len(words) - n + 1] == doc_of[n - 1 :]
        value, doc = mix(value[whole]), doc_of[: len(words) - n + 1][whole]
    else:
        value, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = []
        for d in short:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[first[d] : first[d + 1]]:
                    h = h * np.uint64(0xFF51AFD7ED558CCD) + w
                own.append(h + np.uint64(counts[d]))
        value = np.concatenate([value, mix(np.array(own, np.uint64))])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    return value, doc
