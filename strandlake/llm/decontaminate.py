"""Benchmark decontamination: a broadcast hash set of normalised test windows.

Benchmark items are cut into windows of `window` words; the sorted hashes of all windows
of a block of items make one table with a bitmap in front, which is broadcast. The
scan hashes every window of every whole training text, passes the few that the
bitmap lets through to an exact comparison of the words, and marks every word
inside a confirmed occurrence.

What is broadcast is bounded: items are first cut into overlapping parts of PART_BYTES at most, equal
ones counted once, and dealt to blocks of about BLOCK_BYTES; a block's table is flat arrays, some ten times
its text. A larger benchmark is scanned block by block: each pass merges its marks into
those of the passes before, and the rows are written between passes, so one block at a time is held.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Workspace, small_batches, text_of
from strandlake.llm.wordhash import ALPHANUMERIC, Words, byte_slices, string_buffers

#: Bytes of item text whose windows are broadcast at a time, and of a part of an item.
BLOCK_BYTES, PART_BYTES = 8 << 20, 1 << 18


def word_list(words: Words, a: int, b: int) -> bytes:
    """The words a..b-1, normalised, with one blank between."""
    return b" ".join(words.bytes[s:e].tobytes() for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist()))


class Windows:
    """All windows of a block of benchmark items, by length: sorted hashes, and for each the item and its first word."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [name for name, _ in items]
        data, offsets = string_buffers(pa.array([text or "" for _, text in items], pa.large_string()))
        words = Words(data, offsets, ALPHANUMERIC)
        self.words, counts, first = words, words.counts(), words.first[:-1]
        words.start, words.end = words.start.astype(np.int32), words.end.astype(np.int32)
        self.tables = {}
        for k in sorted(set(np.minimum(counts[counts > 0], window).tolist())):
            hashes, whole = words.windows(k)
            item = np.repeat(np.arange(len(items), dtype=np.int32), counts)[: len(hashes)]
            at = np.flatnonzero(whole & ((counts >= window) if k == window else (counts == k))[item])
            at = at[np.argsort(hashes[at], kind="stable")]
            bits = min(22, max(10, len(at).bit_length() + 4))
            bitmap = np.zeros(1 << bits, bool)
            bitmap[hashes[at] >> np.uint64(64 - bits)] = True
            self.tables[k] = (hashes[at], item[at], at.astype(np.int32), bitmap, np.uint64(64 - bits))
        del words.hash, words.first, first

    def nbytes(self) -> int:
        return sum(x.nbytes for t in self.tables.values() for x in t) + self.words.bytes.nbytes + self.words.start.nbytes + self.words.end.nbytes

    def occurrences(self, words: Words):
        """(first word, number of words, names of items) of every confirmed occurrence."""
        for k, (keys, item, start, bitmap, shift) in self.tables.items():
            hashes, whole = words.windows(k)
            at = np.flatnonzero(bitmap[hashes >> shift] & whole)
            low = np.searchsorted(keys, hashes[at])
            found = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == hashes[at])
            high = np.searchsorted(keys, hashes[at[found]], "right")
            known: dict[tuple[int, bytes], set[str]] = {}
            for i, a, b in zip(at[found].tolist(), low[found].tolist(), high.tolist()):
                text = word_list(words, i, i + k)
                if (a, text) not in known:
                    known[a, text] = {self.names[j] for j, s in zip(item[a:b].tolist(), start[a:b].tolist()) if word_list(self.words, s, s + k) == text}
                if known[a, text]:
                    yield i, k, known[a, text]


def _parts(window: int, part_bytes: int):
    """Items in parts of about part_bytes, each starting window - 1 words before the end of the last, so no window is lost."""
    schema = pa.schema([("item", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            names, texts = [], []
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                if len(text) > part_bytes:
                    data, offsets = string_buffers(pa.array([text]))
                    words, a = Words(data, offsets, ALPHANUMERIC), 0
                    while len(words.hash) >= window and a + window <= len(words.hash):
                        b = max(int(np.searchsorted(words.end, words.start[a] + part_bytes, "right")), a + window)
                        names.append(name)
                        texts.append(data[words.start[a] : words.end[b - 1]].tobytes().decode())
                        if b == len(words.hash):
                            break
                        a = b - window + 1
                    if len(words.hash) >= window:
                        continue
                names.append(name)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], schema=schema)

    return run


def _scan(shared, n_carried: int, schema: pa.Schema, again: bool, cut: bool):
    def run(batches):
        windows = shared.value
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            prior = (batch.column("spans").to_pylist(), batch.column("items").to_pylist()) if again else None
            for x, y in byte_slices(offsets):
                lo = offsets[x]
                words = Words(data[lo : offsets[y]], offsets[x : y + 1] - lo, ALPHANUMERIC)
                first = words.first.tolist()
                edge = np.zeros(len(words.hash) + 1, np.int64)
                items: dict[int, set[str]] = {}
                for i, k, names in windows.occurrences(words):
                    edge[i] += 1
                    edge[i + k] -= 1
                    items.setdefault(int(np.searchsorted(words.first, i, "right")) - 1, set()).update(names)
                if again:
                    for d in range(x, y):
                        if prior[1][d]:
                            items.setdefault(d - x, set()).update(prior[1][d])
                            for s, e in zip(prior[0][d][::2], prior[0][d][1::2]):
                                edge[first[d - x] + s] += 1
                                edge[first[d - x] + e] -= 1
                inside = np.cumsum(edge)[:-1] > 0
                spans, n_hit, clean = [[] for _ in range(y - x)], [0] * (y - x), [None] * (y - x)
                for d in items:
                    a, b = first[d], first[d + 1]
                    hit = inside[a:b]
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    spans[d], n_hit[d] = turn.tolist(), int(hit.sum())
                    if cut:
                        raw, at, kept = data[offsets[x + d] : offsets[x + d + 1]], 0, []
                        for s, e in zip(turn[::2].tolist(), turn[1::2].tolist()):
                            kept.append(raw[at : words.start[a + s] + lo - offsets[x + d]].tobytes())
                            at = words.end[a + e - 1] + lo - offsets[x + d]
                        clean[d] = (b"".join(kept) + raw[at:].tobytes()).decode()
                own = [sorted(items.get(d, ())) for d in range(y - x)]
                columns = [batch.column(f"c{i}").slice(x, y - x) for i in range(n_carried)]
                columns += [batch.column("text").slice(x, y - x)] if "text" in schema.names else []
                made = [spans, own, words.counts().tolist(), n_hit] + ([clean] if "clean" in schema.names else [])
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns + made, schema)], schema=schema)

    return run


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, columns: list[str] | None = None, cut: bool = False, block_bytes: int = BLOCK_BYTES, work: Workspace | None = None) -> DataFrame:
    """The rows of docs with the columns named (all of them by default) and, after them,
    spans: word numbers where runs of hit words start and end, flat; items: the ids of
    items with occurrences, as strings in order; n_words; n_hit. With cut=True also
    clean: the text without its hit runs, null where nothing is hit.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z, of whole texts
    and items. An item with fewer words than a window is one window; one without words
    (also a null text) has none. A null item_id counts as the empty string, and items
    that share an id count once; repeated items are the same as one. A null or empty training text has no
    words; a very long one is scanned whole, and a very long item in parts that overlap. Repeated
    rows are judged each, so ties can't arise; an empty table on either side gives no rows or no hits.
    Columns of docs may have any names: they are carried under others.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    columns = docs.columns if columns is None else columns
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_of())
    items = items.mapInArrow(_parts(window, min(PART_BYTES, block_bytes)), "item string, text string").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // block_bytes))
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], text_of())
    carried = [f"{f'c{i}'} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)]
    made = ["spans array<long>", "items array<string>", "n_words long", "n_hit long"]
    if blocks > 1:
        items = (work := work or Workspace(spark)).save(items, "items")
    for block in range(blocks):
        last = block == blocks - 1
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(Windows([tuple(r) for r in own.collect()], window))  # a block: BLOCK_BYTES in expectation
        out = ", ".join(carried + ([] if last else ["text string"]) + made + (["clean string"] if cut and last else []))
        schema = to_arrow_schema(spark.createDataFrame([], out).schema)
        rows = rows.mapInArrow(_scan(shared, len(columns), schema, block > 0, cut and last), out)
        if not last:
            rows = work.save(rows, "marks").select(*[f"c{i}" for i in range(len(columns))], "text", "spans", "items")
    return rows.toDF(*columns, *rows.columns[len(columns) :])


def verdict(n_hit="n_hit", n_words="n_words"):
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def judged(docs: DataFrame, benchmark: DataFrame, window: int = 13, **more) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items for each row of docs."""
    found = scan(docs, benchmark, window, ["doc_id"], **more)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), verdict().alias("contaminated"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, **more) -> DataFrame:
    """docs without its contaminated rows; in the others the hit runs of words are cut out.

    n_chars, where docs has it, follows the text. Rows without a hit stay as they are.
    """
    n = len(docs.columns)
    found = scan(docs, benchmark, window, cut=True, **more)
    spare = [f"c{i}" for i in range(n)]
    found = found.toDF(*spare, "spans_", "items_", "n_words_", "n_hit_", "clean_").where(~verdict("n_hit_", "n_words_"))
    out = []
    for name, c in zip(docs.columns, spare):
        kind = docs.schema[name].dataType
        value = F.col(c)
        if name == "text":
            value = F.coalesce("clean_", c)
        elif name == "n_chars":
            value = F.when(F.col("clean_").isNull(), F.col(c)).otherwise(F.length("clean_")).cast(kind)
        out.append(value.alias(name))
    return found.select(*out)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
