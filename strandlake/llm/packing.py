"""Packing token ids into training sequences by minimum bin slack.

A document's ids are cut into full windows of the capacity and one remainder. Full
windows are sequences of their own. For the remainders only their lengths matter,
so a histogram of lengths below the capacity is the whole problem, however large
the corpus: at most capacity - 1 counts come to the driver.

There the windows are filled one kind at a time. The longest remaining length
seeds a window; a subset-sum over the other lengths and their counts, with one bit
for each fill level in a big integer, finds the multiset that leaves least slack,
and walking the stored bitsets back gives how many of each length it takes. The
pattern is repeated as often as the counts allow. Each repetition exhausts some
length below its use, so there are at most sum(capacity / length) patterns.

Every piece learns its place from its rank among the pieces of its length. Ranks
come from counts by (part, length), where a part is a hash bucket of documents:
rows of one length are never gathered, though a third of all rows may share it.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import Workspace, batch_of, partitions, small_batches, text_of

CAPACITY = 2048
END = 1
#: Entries of the word cache of one worker.
CACHE = 300_000


class _Uneven(Exception):
    """A text whose blanks don't stand one by one between other characters."""


class Encoder(dict):
    """Ids of byte-level BPE texts as little-endian 32-bit integers.

    A pre-token never crosses a single blank between two other non-blank characters
    and takes that blank with it. So a text can be cut there, and the pieces, which
    repeat a lot, are kept in a bounded cache. Texts with other runs of blanks are
    cut at the safe places only.
    """

    def __init__(self, json_file: str, ranks_file: str, pattern: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.piece = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(json_file)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.safe = re.compile(r"(?<=\S) (?=\S)").split

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Uneven
        ids = np.array(self.piece(" " + piece), "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(piece) < 40:
            self[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        for special in self.special:
            if special in text:  # rare: these strings are one id
                return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = text.split(" ")
        try:
            if not pieces[0] or pieces[0][-1].isspace():
                raise _Uneven
            return np.array(self.piece(pieces[0]), "<u4").tobytes() + b"".join(map(self.__getitem__, pieces[1:]))
        except _Uneven:
            pieces = self.safe(text)
            return b"".join(np.array(self.piece(p if i == 0 else " " + p), "<u4").tobytes() for i, p in enumerate(pieces))


_encoders: dict = {}


def encoder(json_file: str, ranks_file: str, pattern: str) -> Encoder:
    key = (json_file, ranks_file, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def byte_bpe_files() -> tuple[str, str, str]:
    """The vocabulary of the public 50k byte-level BPE: (tokenizers file, the same as ranks, pattern)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """A multiset of lengths, within their counts, whose sum is as near below `room` as can be.

    Bit s of a bitset tells whether the sum s can be made of the lengths seen so far.
    A count c is split into 1, 2, 4, ... copies, so a length costs log(c) shifts.
    """
    limit, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if 0 < x <= room and counts[x] > 0), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            take = min(copies, left)
            trail.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            left, copies = left - take, copies * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (lengths with their numbers, repetitions) that use up all counts."""
    counts, patterns = {k: v for k, v in counts.items() if v > 0}, []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        used = fill(counts, capacity - seed)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[x] // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        patterns.append((used, times))
    return patterns


def slots(patterns, capacity: int) -> dict[int, np.ndarray]:
    """For each length rows (first rank, pieces in a sequence, first sequence, offset there)."""
    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for used, times in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.setdefault(length, []).append((rank.get(length, 0), n, sequence, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()} | {0: np.array([[sequence]])}


def _pieces(files, capacity: int, end: int):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        encode = encoder(*files)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = memoryview(encode(text) + last)
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    for column, value in zip(out, (doc, at, len(piece) // 4, zlib.crc32(piece), n)):
                        column.append(value)
            yield batch_of(schema, *out)

    return run


def _place(shared, capacity: int):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches):
        places = shared.value
        full = int(places[0][0, 0])
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = full + rank, np.zeros(len(rank), np.int64)
            for x in np.unique(length[length < capacity]).tolist():
                own = np.flatnonzero(length == x)
                rows = places[x]
                row = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + nth // row[:, 1]
                offset[own] = row[:, 3] + nth % row[:, 1] * x
            yield batch_of(schema, *[batch.column(c) for c in schema.names[:5]], sequence, offset)

    return run


def pack(docs: DataFrame, files: tuple[str, str, str] | None = None, capacity: int = CAPACITY, end: int = END, work: Workspace | None = None) -> DataFrame:
    """One row for every piece of every row of docs(doc_id, text).

    doc_id; start: the number of its document's ids before it; length; ids_crc32 of the
    ids as little-endian unsigned 32-bit integers; doc_tokens: ids of the document with
    the end id; sequence_id; offset in that sequence, without gaps from 0. A sequence
    holds at most `capacity` ids.

    A null or empty text is the end id alone. Rows that repeat an id, or have none, are
    packed each; pieces of one length are ranked by id, start and content, and full repeats are
    interchangeable. An empty table gives no rows. Other columns are ignored. A text is
    held whole by one task; the ids of different texts are not.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = work or Workspace(spark)
    files = files or byte_bpe_files()
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of()).mapInArrow(_pieces(files, capacity, end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    parts = partitions(spark)
    pieces = work.save(cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int")), "pieces")

    counts = work.save(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.where(F.col("length") < capacity).groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(slots(plan(histogram, capacity), capacity))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("nth", F.row_number().over(within)).join(bases.hint("merge"), ["length", "part"])  # not broadcast: it grows with the parts
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(_place(shared, capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
