"""Words, windows and their 64-bit hashes, computed on Arrow string buffers.

Everything here works on the UTF-8 bytes of a whole record batch at once: the
word classes used by the operators only distinguish ASCII bytes, so a byte table
decides what is a word byte, and no Python string is made per word.

Hashes are polynomial hashes over random per-byte values modulo 2**64, finished
by a full avalanche, and so depend on the word alone, not on where it stands.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: `[^\x20\x09-\x0D]+` after A-Z became a-z.
BLANK_SEPARATED = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z: digits, letters, all non-ASCII.
ALPHANUMERIC = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)

_SPAN = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIERS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


_POW, _INV = _powers(_BASE, _SPAN + 1), _powers(_INVERSE, _SPAN + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls are empty strings."""
    import pyarrow as pa

    if hasattr(array, "combine_chunks"):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not wide and not (pa.types.is_string(array.type) or pa.types.is_binary(array.type)):
        array, wide = array.cast(pa.large_string()), True
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    _, offsets, data = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch of texts.

    start, end: byte ranges; hash: 64-bit hash; first: for each text, the index of
    its first word, and at the end the number of words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        self.bytes = low = _LOWER[data]
        inside = word_bytes[low]
        before = np.zeros(len(low), bool)
        before[1:] = inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(low)]
        before[edges] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(low), bool)
        after[:-1] = inside[1:]
        ends = offsets[1:][offsets[1:] > 0]
        after[ends - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        global _POW, _INV
        out = np.empty(len(self.start), np.uint64)
        w = 0
        while w < len(out):
            lo = self.start[w]
            e = max(int(np.searchsorted(self.end, lo + _SPAN, "right")), w + 1)
            n = int(self.end[e - 1] - lo)
            if n >= len(_POW):
                _POW, _INV = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.bytes[lo : lo + n]] * _POW[:n], out=sums[1:])
            s = self.start[w:e] - lo
            out[w:e] = (sums[self.end[w:e] - lo] - sums[s]) * _INV[s]
            w = e
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows, whichever text they start in, and which lie in one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += self.hash[j : j + n] * _MULTIPLIERS[j % 64] ** np.uint64(1 + j // 64)
        last = np.repeat(self.first[1:], self.counts())[:n]  # end of the text of each word
        return mix(total + np.uint64(k)), np.arange(n) + k <= last

    def sequence(self, a: int, b: int) -> np.uint64:
        """Hash of the words a..b-1 as one window of that many words."""
        k = b - a
        total = np.zeros(1, np.uint64)
        for j in range(k):
            total += self.hash[a + j : a + j + 1] * _MULTIPLIERS[j % 64] ** np.uint64(1 + j // 64)
        return mix(total + np.uint64(k))[0]


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word windows.

    A text of fewer than k words, but not none, has its whole sequence as the one
    element; a text without words has the empty set.
    """
    hashes, whole = words.windows(k)
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            sets.append(np.unique(hashes[a : b - k + 1]))
        elif b > a:
            sets.append(np.array([words.sequence(a, b)], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def byte_slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Ranges of texts holding about `limit` bytes at most, or one longer text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1, a + 1)
        yield a, b
        a = b
