"""Words of a batch of texts as numpy arrays: places, documents, hashes.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r; in UTF-8 no
other character contains these bytes. Hashes have 64 bits and depend on the
bytes alone."""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 20        # bytes hashed at once; a longer word is hashed alone
_ROOT = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1342543DE82EF95)

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_POWERS: list[np.ndarray] = []


def mix(h):
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int):
    """Powers of the root and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SEGMENT + 1)
        out = []
        for base in (_ROOT, pow(_ROOT, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS


def _hash(data, starts, ends):
    """Hash of each word from prefix sums of byte times power of its place."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP)


class Words:
    """``data`` bytes of all texts, ``offsets`` of the texts, and for each
    word ``starts``, ``ends``, ``doc`` and ``hash``."""

    def __init__(self, texts, lower: bool = False):
        import pyarrow as pa

        texts = texts.cast(pa.string()).fill_null("")
        _, at, body = texts.buffers()
        offsets = np.frombuffer(at, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) \
            if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None and len(texts) \
            else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = _LOWER[data] if lower else data
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_SEPARATOR[data]
        bound = np.zeros(n + 1, bool)
        bound[self.offsets] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | bound))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | bound))
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.hash = np.empty(len(self.starts), np.uint64)
        first = 0
        while first < len(self.starts):   # whole words, about SEGMENT bytes of them
            base = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, base + SEGMENT, "right")))
            part = slice(first, last)
            self.hash[part] = _hash(self.data[base:self.ends[last - 1]], self.starts[part] - base, self.ends[part] - base)
            first = last

    def first_word(self):
        """Index of each text's first word, and the end."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)))

    def windows(self, k: int):
        """(first words of the windows of k words within a text, hashes)."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * _STEP + self.hash[j:j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return at, mix(h[at])
