"""Sequences as numpy arrays: all windows of a whole Arrow batch at once.

Values of windows are built by doubling: those of length a + b from those of lengths
a and b, so a window of k bases takes about 2 * log2(k) passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CODE = np.full(256, 255, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    CODE[_b] = CODE[_b + 32] = _i
LETTER = np.frombuffer(b"ACGT", np.uint8)

# Seeds of the published ntHash function for A, C, G, T.
_SEED = np.array([0x3C8BFBB395C60474, 0x3193C18562A02B4C, 0x20323ED082572324, 0x295549F54BE24456], np.uint64)
_SIGN = np.uint64(1 << 63)


def buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; nulls are empty."""
    binary = pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type)
    array = array.fill_null(b"" if binary else "") if array.null_count else array
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def valid_windows(codes: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k bases that lie in one row and hold bases only."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bad = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(codes > 3, out=bad[1:])
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return np.flatnonzero((bad[k:] == bad[:n]) & (np.arange(k, n + k) <= ends))


def _double(one, join, length: int):
    """Values of windows of `length`, from those of single places and a way to join neighbours."""
    result, size, power, width = None, 0, one, 1
    while True:
        if length & width:
            result, size = (power, width) if result is None else (join(result, size, power, width), size + width)
        width *= 2
        if width > length:
            return result
        power = join(power, width // 2, power, width // 2)


def _cut(a, at, n):
    return a[at : at + n]


def _eights(codes: np.ndarray) -> np.ndarray:
    """Two bits a base of the eight bases from each place on, the first highest; after the end, and where there is no base, A."""
    full = np.zeros(len(codes) + 8, np.uint16)
    full[: len(codes)] = codes & 3
    for width in (1, 2, 4):
        full = (full[: len(full) - width] << np.uint16(2 * width)) | full[width:]
    return full


def _forward(eights: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Values of the windows of `length` bases at the places given, 32 at most, the last base lowest."""
    if length < 8:
        return (eights[at] >> np.uint16(16 - 2 * length)).astype(np.uint64)
    value = eights[at].astype(np.uint64)
    for j in range(8, length - 7, 8):
        value = value << np.uint64(16) | eights[at + j]
    rest = length % 8
    if rest:
        value = value << np.uint64(2 * rest) | (eights[at + length - 8] & np.uint16((1 << 2 * rest) - 1))
    return value


#: Bytes with their four bases in reverse order, complemented; and spelled, in the order of memory.
_REVERSED = np.array([sum((3 - (b >> 2 * i & 3)) << 6 - 2 * i for i in range(4)) for b in range(256)], np.uint8)
_SPELLED = np.array([[LETTER[b >> s & 3] for s in (6, 4, 2, 0)] for b in range(256)], np.uint8).view(np.uint32).ravel()


def _reverse_complement(values: np.ndarray, length: int) -> np.ndarray:
    reverse = _REVERSED[values.astype(">u8").view(np.uint8)].view("<u8")  # big-endian bytes read as little-endian
    return reverse.astype(np.uint64) >> np.uint64(64 - 2 * length)


def canonical_words(codes: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The canonical k-mers at the places given, as words of 32 bases, the last left-aligned (alone: right-aligned)."""
    n, rest = -(-k // 32), (k - 1) % 32 + 1
    if not len(at):
        return [np.zeros(0, np.uint64)] * n
    eights = _eights(codes)
    if k <= 32:
        value = _forward(eights, at, k)
        return [np.minimum(value, _reverse_complement(value, k))]
    shift = np.uint64(64 - 2 * rest)
    one = [_forward(eights, at + 32 * j, 32) for j in range(n - 1)] + [_forward(eights, at + 32 * (n - 1), rest) << shift]
    two = [_reverse_complement(_forward(eights, at + k - 32 * (j + 1), 32), 32) for j in range(n - 1)] + [_reverse_complement(_forward(eights, at, rest), rest) << shift]
    less, equal = np.zeros(len(at), bool), np.ones(len(at), bool)
    for x, y in zip(one, two):
        less |= equal & (x < y)
        equal &= x == y
    return [np.where(less, x, y) for x, y in zip(one, two)]


def words_of(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k-mers at the places given as they stand, at most 32 bases, the last base lowest."""
    return _forward(_eights(codes), at, k)


def letters(words: np.ndarray, k: int) -> np.ndarray:
    """ASCII letters, a row for each k-mer, from rows of words as canonical_words lays them out."""
    if k <= 32:
        words = words << np.uint64(64 - 2 * k)
    return _SPELLED[words.astype(">u8").view(np.uint8).reshape(len(words), -1)].view(np.uint8).reshape(len(words), -1)[:, :k]


#: What stays of a part's last byte, by the bases in it (0 is four).
_TAIL = np.array([0xFF, 0xC0, 0xF0, 0xFC], np.uint8)


def pack_all(codes: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the parts): the n codes from each place on, four to a byte, the first in the highest bits, zero padded."""
    widths = -(-n // 4)
    offsets = np.concatenate([[0], np.cumsum(widths)])
    full = np.zeros(len(codes) + 3, np.uint8)
    full[: len(codes)] = codes & 3
    fours = full[:-3] << 6 | full[1:-2] << 4 | full[2:-1] << 2 | full[3:]
    packed = fours[np.repeat(at - 4 * offsets[:-1], widths) + 4 * np.arange(int(offsets[-1]))]
    some = np.flatnonzero(widths)
    packed[offsets[1:][some] - 1] &= _TAIL[n[some] % 4]
    return packed, offsets


_CODES = np.array([[b >> s & 3 for s in (6, 4, 2, 0)] for b in range(256)], np.uint8).view(np.uint32).ravel()


def packed_words(data: np.ndarray, n: np.ndarray, k: int) -> list[np.ndarray]:
    """canonical_words of all windows of the parts of n codes that pack_all made."""
    first = np.cumsum(-(-n // 4)) - -(-n // 4)
    windows = np.maximum(n - k + 1, 0)
    at = np.repeat(4 * first - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    return canonical_words(_CODES[data].view(np.uint8), at, k)


def unpack_all(data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) of parts of n codes that pack_all made."""
    full = np.stack([data >> 6, data >> 4 & 3, data >> 2 & 3, data & 3], 1).ravel()
    widths = -(-n // 4)
    first = np.cumsum(n) - n
    nth = np.arange(int(n.sum()))
    return full[np.repeat(4 * (np.cumsum(widths) - widths) - first, n) + nth], np.concatenate([[0], np.cumsum(n)])


def first_of(values: np.ndarray, least: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """For each place of `at` how far on the first of `width` values stands that is the least given."""
    out = np.full(len(at), width, np.int32)
    for j in range(width - 1, -1, -1):
        out[values[np.minimum(at + j, len(values) - 1)] == least] = j
    return out


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def string_array(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    offsets = np.arange(0, (n + 1) * k, k, dtype=np.int64)[: n + 1]
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())).cast(pa.string())


def _rol(x: np.ndarray, n: int) -> np.ndarray:
    n %= 64
    return x if not n else (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def nthash(codes: np.ndarray, m: int) -> np.ndarray:
    """Canonical ntHash (forward XOR reverse) of every window of m bases."""
    def ahead(a, la, b, lb):
        n = min(len(a), len(b) - la)
        return _rol(a[:n], lb) ^ _cut(b, la, n)

    def behind(a, la, b, lb):
        n = min(len(a), len(b) - la)
        return a[:n] ^ _rol(_cut(b, la, n), la)

    c = codes & 3
    return _double(_SEED[c], ahead, m) ^ _double(_SEED[3 - c], behind, m)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    n = len(values) - (width - size)
    return np.minimum(values[:n], values[width - size :]) if width > size else values


def nthash_constants(m: int) -> list[tuple[int, str, int]]:
    """(place, base, value): a window's canonical ntHash is the XOR of the values of its bases, for use in SQL."""
    rol = lambda x, n: ((x << n % 64) | (x >> (64 - n % 64))) & (2**64 - 1) if n % 64 else x
    seed = [int(x) for x in _SEED]
    return [(i, "ACGT"[b], rol(seed[b], m - 1 - i) ^ rol(seed[3 - b], i)) for i in range(m) for b in range(4)]
