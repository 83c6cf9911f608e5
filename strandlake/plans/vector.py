"""The vectorised plan: k-mers of Arrow batches as numpy arrays, one exchange by k-mer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import bases

#: Window starts that are worked on together, and k-mers that are counted together.
SLICE = 1 << 20


def slices(data: np.ndarray, offsets: np.ndarray, k: int, size: int = SLICE):
    """(codes, offsets, first place) of parts that overlap by k - 1, so that every window is in one part."""
    for at in range(0, max(len(data) - k + 1, 0), size):
        end = min(at + size + k - 1, len(data))
        yield bases.CODE[data[at:end]], np.unique(np.clip(offsets, at, end) - at), at


def summed(words: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of words in order, and how often they occur (or the sums of n)."""
    if not len(words[0]):
        return words, np.zeros(0, np.int64)
    if len(words) == 1 and n is None:
        key, n = np.unique(words[0], return_counts=True)
        return [key], n
    order = np.argsort(words[0], kind="stable") if len(words) == 1 else np.lexsort(words[::-1])
    rows = [w[order] for w in words]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in rows])
    first = np.flatnonzero(new)
    return [w[first] for w in rows], np.diff(np.append(first, len(order))) if n is None else np.add.reduceat(n[order], first)


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def gathered(words: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """summed, in the order in which the rows first occur.

    One sort of integers: a row's mixed bits above its place. Rows whose mixed bits are alike are compared, and sorted
    by their words where they differ.
    """
    size = len(words[0])
    if not size:
        return words, np.zeros(0, np.int64)
    places = max(1, (size - 1).bit_length())
    key = words[0] * _MIX[0]
    key ^= key >> np.uint64(32)
    for w in words[1:]:
        key += w
        key *= _MIX[1]
        key ^= key >> np.uint64(29)
    key *= _MIX[2]
    low = np.uint64((1 << places) - 1)
    key &= ~low
    key |= np.arange(size, dtype=np.uint64)
    key.sort()
    order = (key & low).astype(np.int64)
    key >>= np.uint64(places)
    new = np.ones(size, bool)
    new[1:] = key[1:] != key[:-1]
    del key
    differ = np.zeros(size, bool)
    for w in words:
        row = w[order]
        differ[1:] |= row[1:] != row[:-1]
    mixed = differ & ~new
    if mixed.any():
        group = np.cumsum(new) - 1
        bad = np.zeros(group[-1] + 1, bool)
        bad[group[mixed]] = True
        at = np.flatnonzero(bad[group])
        own = order[at]
        by = np.lexsort((*(w[own] for w in words[::-1]), group[at]))  # of equal rows the first stays first
        order[at] = own[by]
        change = np.logical_or.reduce([np.diff(w[order[at]], prepend=w[order[at[0]]]) != 0 for w in words])
        new[at] |= change
    first = np.flatnonzero(new)
    sums = np.diff(np.append(first, size)) if n is None else np.add.reduceat(n[order], first)
    total = np.zeros(size, np.int64)
    total[order[first]] = sums
    kept = np.flatnonzero(total)
    return [w[kept] for w in words], total[kept]


class Tally:
    """Counts of k-mers of any number of codes arrays, merged like the runs of a log-structured table.

    It holds the distinct k-mers only, in the order in which they first occur, and a run is merged when the next one has grown as long.
    """

    def __init__(self, k: int):
        self.k, self.runs = k, []

    def add(self, codes: np.ndarray, ends: np.ndarray) -> None:
        self.add_words(bases.canonical_words(codes, bases.valid_windows(codes, ends, self.k), self.k))

    def add_words(self, words: list[np.ndarray]) -> None:
        run = gathered(words)
        while self.runs and len(self.runs[-1][1]) <= 2 * len(run[1]):
            run = self._merged(self.runs.pop(), run)
        self.runs.append(run)

    @staticmethod
    def _merged(a, b):
        return gathered([np.concatenate(w) for w in zip(a[0], b[0])], np.concatenate([a[1], b[1]]))

    def counts(self) -> tuple[list[np.ndarray], np.ndarray]:
        while len(self.runs) > 1:
            last = self.runs.pop()
            self.runs.append(self._merged(self.runs.pop(), last))
        return self.runs[0] if self.runs else ([np.zeros(0, np.uint64)], np.zeros(0, np.int64))


def _counter(k: int):
    kind = pa.int64() if k <= 32 else pa.binary()
    schema = pa.schema([("key", kind), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            data, offsets = bases.buffers(batch.column(0))
            for codes, ends, _ in slices(data, offsets, k):
                words = bases.canonical_words(codes, bases.valid_windows(codes, ends, k), k)
                if k <= 32:
                    key, n = np.unique(words[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], schema=schema)
                elif len(words[0]):
                    rows, n = summed(words)
                    flat = np.ascontiguousarray(np.stack(rows, 1).astype(">u8"))
                    width = 8 * len(words)
                    ends_ = pa.py_buffer(np.arange(0, (len(n) + 1) * width, width, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(n), [None, ends_, pa.py_buffer(flat.tobytes())]), pa.array(n)], schema=schema)

    return run, f"key {'long' if k <= 32 else 'binary'}, n long"


def count_keys(df: DataFrame, seq: str, k: int) -> DataFrame:
    """key, count: canonical k-mers as longs (k <= 32) or big-endian words, pre-counted in each batch slice."""
    run, kind = _counter(k)
    return df.select(F.col(seq)).mapInArrow(run, kind).groupBy("key").agg(F.sum("n").alias("count"))


def decoded(counts: DataFrame, k: int) -> DataFrame:
    """kmer, count from key, count."""
    schema = pa.schema([("kmer", pa.string()), ("count", pa.int64())])

    def run(batches):
        for batch in batches:
            key = batch.column("key")
            if k <= 32:
                words = key.to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
            else:
                flat, _ = bases.buffers(key)  # keys are equally long
                words = np.frombuffer(flat.tobytes(), ">u8").astype(np.uint64).reshape(len(key), -1)
            if len(key):
                yield pa.RecordBatch.from_arrays([bases.string_array(bases.letters(words, k)), batch.column("count")], schema=schema)

    return counts.mapInArrow(run, "kmer string, count long")


def valued(counts: DataFrame, k: int) -> DataFrame:
    """kmer, count, value, decoded: what seqops.encode and seqops.decode give of k-mers of at most 32 bases, a batch at a time."""
    schema = pa.schema([("kmer", pa.string()), ("count", pa.int64()), ("value", pa.int64()), ("decoded", pa.string())])

    def run(batches):
        for batch in batches:
            if len(batch):
                data, offsets = bases.buffers(batch.column("kmer"))
                words = bases.words_of(bases.CODE[data], offsets[:-1], k)
                yield pa.RecordBatch.from_arrays([batch.column("kmer"), batch.column("count"), pa.array(words.view(np.int64)), bases.string_array(bases.letters(words[:, None], k))], schema=schema)

    return counts.select("kmer", "count").mapInArrow(run, "kmer string, count long, value long, decoded string")


def letter_counts(df: DataFrame, text: str) -> DataFrame:
    """c, n: occurrences of each ASCII letter, a row for each letter of each task. Bytes of other characters are no letters in UTF-8."""

    def run(batches):
        n = np.zeros(256, np.int64)
        for batch in batches:
            data, _ = bases.buffers(batch.column(0))
            for at in range(0, len(data), SLICE):
                n += np.bincount(data[at : at + SLICE], minlength=256)
        found = [b for b in np.flatnonzero(n).tolist() if chr(b).isalpha() and b < 128]
        yield pa.RecordBatch.from_arrays([pa.array([chr(b) for b in found], pa.string()), pa.array(n[found])], names=["c", "n"])

    return df.select(text).mapInArrow(run, "c string, n long")
