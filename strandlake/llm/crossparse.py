"""Language-model scoring by Ziv-Merhav cross-parsing.

A document is factored greedily into the longest phrases that occur in a reference text (a
character that does not occur is a phrase of its own). With c phrases against a reference
of N characters and c0 phrases of the document's own incremental (LZ78) parsing, the
relative entropy estimate of Ziv and Merhav (1993), for a reference that is longer than the
text, is (c log2 N - c0 log2 c0) / n bits per character of a text of n: the less a document
looks like the reference, the higher. A phrase costs a place in the reference, so many
bits; LZ78 costs a short text more than that, so a text of which the corpus knows long
stretches has a score below 0.

The reference is the corpus itself: every other document, in two parts that leave out nothing.

Blocks. All texts are dealt to blocks of about BLOCK characters by a hash, and every text
is parsed against the whole rest of its block. The places of a text's longest match
are the states of a suffix automaton; for all texts of a block at once they come from the
automaton's sorted form: states of the automaton of the reversed block are the intervals of
its sorted suffixes that share a prefix, and the longest match of a place with other
documents is the depth of the least interval around it that holds another document's suffix.

Corpus. A phrase of two dozen characters or more may stand in any other block. Every text is cut
into pieces where a hash of CUT characters is the least of GAP places on each side (49
characters on average, 25 at least), so equal passages are cut alike wherever they stand. Pieces
of all documents meet by their hash. A piece that another document has is linked with one
such place, the same for all pieces of a passage; adjacent pieces whose places are adjacent make one
match, as long as the passage. The parsing takes the longer of the two matches at every place.

What is not found: a match of another block that holds no whole piece (shorter than some
100 characters), and a longer one's ends up to the first and from the last border of a piece.

A given reference text, as of a benchmark or a language, goes by `against`, with the suffix
automaton itself.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import Workspace, batch_of, partitions, small_batches, text_of
from strandlake.llm.wordhash import mix

#: Characters of a block, in expectation; a task cuts a block off at twice as many.
BLOCK = 1 << 20
#: Longer texts are parsed in segments of this many characters, dealt to blocks each.
SEGMENT = 1 << 16
CUT, GAP, PIECE = 8, 24, 49
#: Longest reference text of `against`: its automaton takes some 600 bytes a character in every worker.
REFERENCE = 1_000_000
#: A piece of over HOT_ROWS rows, and over one in HOT of all, is hot: such are broadcast, HOT at most. Found in one document of SAMPLE.
HOT, HOT_ROWS, SAMPLE = 20_000, 1 << 20, 64
_LOW = (1 << 20) - 1
_ODD = np.array([0x9E3779B97F4A7C15], np.uint64)


def automaton(text: str) -> dict:
    """The start state of the suffix automaton of text: states are dicts from a character to the next state."""
    start: dict = {}
    links, lengths, states = [-1], [0], [start]
    last = 0
    for i, c in enumerate(text):
        now = len(states)
        state: dict = {}
        states.append(state)
        lengths.append(i + 1)
        links.append(0)
        p = last
        while p != -1 and c not in states[p]:
            states[p][c] = now
            p = links[p]
        if p != -1:
            q = states[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[now] = q
            else:
                copy = len(states)
                states.append(states[q].copy())
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p != -1 and states[p].get(c) == q:
                    states[p][c] = copy
                    p = links[p]
                links[q] = links[now] = copy
        last = now
    for state in states:
        for c, q in state.items():
            state[c] = states[q]
    return start


def cross_phrases(text: str, start: dict) -> int:
    """Number of phrases in the greedy factoring of text by longest matches in the automaton's text."""
    count, state = 0, start
    for c in text:
        following = state.get(c)
        if following is None:
            if state is not start:
                count += 1
            following = start.get(c)
            if following is None:  # a phrase of one unknown character
                count += 1
                following = start
        state = following
    return count + (state is not start)


def own_phrases(text: str) -> int:
    """Number of phrases of the incremental (LZ78) parsing of text."""
    root: dict = {}
    count, state = 0, root
    for c in text:
        following = state.get(c)
        if following is None:
            state[c] = {}
            count += 1
            state = root
        else:
            state = following
    return count + (state is not root)


def own_bits(phrases: int) -> float:
    return phrases * math.log2(max(phrases, 1))


class Suffixes:
    """The sorted suffixes of a text of symbols below 2**bits, and the longest common prefixes of neighbours.

    order: places by their suffix; common[r]: symbols that the suffixes order[r - 1] and
    order[r] share. Sorted by words of `width` symbols, then by twice as many at a time, and
    each time only the places that others still equal.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        n, self.bits, width = len(symbols), bits, 63 // bits
        words, held = np.concatenate([symbols, np.zeros(width, np.int64)]), 1
        while held < width:  # `held` symbols from each place on, then up to twice as many
            step = min(held, width - held)
            longer = words << (step * bits)
            longer[:-step] |= words[step:] & ((1 << (step * bits)) - 1)
            words, held = longer, held + step
        self.n, self.words = n, words
        self.order = order = np.argsort(words[:n])
        found = words[order]
        fresh = np.ones(n, bool)
        np.not_equal(found[1:], found[:-1], out=fresh[1:])
        self.common = np.zeros(n, np.int64)
        at = np.flatnonzero(fresh[1:]) + 1
        self.common[at] = self._equal(found[at - 1], found[at])
        # for each place the first position of its group of equals so far; -1 after the end
        rank = np.full(n + 1, -1, np.int32)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), np.int32(0)))
        self.ranks, depth, index = [rank], width, np.arange(n)
        while True:
            tied = ~fresh[index]
            tied[:-1] |= tied[1:]  # the first of a group is fresh itself
            index = index[tied]
            if not len(index):
                break
            sub = order[index]
            # suffixes that end before are below all others, the shorter first
            after = np.where(sub + depth < n, rank[np.minimum(sub + depth, n)].astype(np.int64) + n + 1, n - sub)
            key = rank[sub].astype(np.int64) * (2 * n + 2) + after
            moved = np.argsort(key)
            key, sub = key[moved], sub[moved]
            order[index] = sub
            apart = np.flatnonzero((key[1:] != key[:-1]) & ~fresh[index[1:]]) + 1
            at = index[apart]
            fresh[at] = True
            rank = rank.copy()
            rank[sub] = np.maximum.accumulate(np.where(fresh[index], index, 0))
            self.ranks.append(rank)
            self.common[at] = self._shared(order[at - 1], order[at], depth)
            depth *= 2
        del self.ranks

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that two different words share at their start."""
        x = a ^ b
        x &= ~(x >> 1)  # so that no rounding reaches the next power of two
        highest = (x.astype(np.float64).view(np.int64) >> 52) - 1022  # number of bits, from the exponent
        return (63 // self.bits * self.bits - np.maximum(highest, 0)) // self.bits

    def _shared(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """Length of the common prefix of suffixes that agree for `depth` symbols but not for twice as many."""
        n, width, length = self.n, 63 // self.bits, np.full(len(a), depth)
        a, b = np.minimum(a + depth, n), np.minimum(b + depth, n)
        for t in range(len(self.ranks) - 3, -1, -1):
            step = np.where(self.ranks[t][a] == self.ranks[t][b], width << t, 0)
            length += step
            a, b = np.minimum(a + step, n), np.minimum(b + step, n)
        return length + self._equal(self.words[a], self.words[b])


def longest_matches(symbols: np.ndarray, bits: int, owner: np.ndarray) -> np.ndarray:
    """For each place the most symbols from there on that also stand at a place of another owner."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    suffixes = Suffixes(symbols, bits)
    order, common = suffixes.order, suffixes.common
    own = owner[order]
    run = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
    far = len(symbols) + 1
    # the least common prefix from a run's border on, started anew in every run
    best = np.minimum.accumulate(common - run * far) + run * far
    below, back = np.append(common[1:], 0)[::-1], (run[-1] - run)[::-1]
    np.maximum(best, (np.minimum.accumulate(below - back * far) + back * far)[::-1], out=best)
    out = np.empty(len(symbols), np.int64)
    out[order] = best
    return out


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of all texts: number of the text, first character, length, hash."""
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(lengths + GAP) - lengths  # GAP places between texts, so that none sees another
    ends = first + lengths
    points = np.frombuffer(("\0" * GAP).join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points)
    # hash of the CUT characters before each place of a text; the greatest value where there are fewer
    window, span, power = points, 1, _ODD
    while span < CUT:  # twice as many characters at a time
        window, span, power = window[:-span] * power + window[span:], 2 * span, power * power
    window = window[: n - CUT]
    long = lengths > CUT
    change = np.zeros(n + 1, np.int8)
    change[first[long] + CUT], change[ends[long]] = 1, -1
    seen = np.full(n, 2**32 - 1, np.uint32)
    np.copyto(seen[CUT:], (mix(window) >> np.uint64(33)).astype(np.uint32), where=np.cumsum(change[CUT:n], dtype=np.int8).astype(bool))
    least, span = seen, 1  # of GAP places from each on
    while span < GAP:
        step = min(span, GAP - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    here = seen[GAP : n - GAP]
    cuts = np.flatnonzero((here < least[: len(here)]) & (here <= least[GAP + 1 :][: len(here)])) + GAP
    starts = np.union1d(np.concatenate([cuts, first]), ends)
    sizes = np.diff(np.append(starts, n))
    at = (np.arange(n - starts[0]) - np.repeat(starts - starts[0], sizes)).astype(np.uint64)
    sums = np.add.reduceat(mix(points[starts[0] :] * _ODD + at), starts - starts[0])
    inside = ~np.isin(starts, ends, assume_unique=True)
    starts, sizes, sums = starts[inside], sizes[inside], sums[inside]
    text = np.searchsorted(first, starts, "right") - 1
    return text, starts - first[text], sizes, mix(sums + sizes.astype(np.uint64))


def _segmented(batch):
    """(doc, number of the segment, doc_id, copies, text) of the different documents of a batch."""
    copies: dict = {}
    for doc, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("doc", "doc_id", "text")]):
        known = copies.setdefault(doc, [doc_id, 0, text])
        known[1] += 1
    for doc, (doc_id, n, text) in copies.items():
        for i in range(max(1, -(-len(text) // SEGMENT))):
            yield doc, i, doc_id, n, text[i * SEGMENT : (i + 1) * SEGMENT]


def _segments(batches):
    schema = pa.schema([("doc", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("copies", pa.int64()), ("text", pa.string())])
    for batch in batches:
        rows = list(_segmented(batch))
        for a in range(0, len(rows), 2000):
            yield batch_of(schema, *(zip(*rows[a : a + 2000])))


def _pieces(batches):
    """(piece, doc, place) of every piece; place holds the segment, the first character in it (16 bits) and the length (17 bits)."""
    schema = pa.schema([("piece", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])

    def made(rows):
        text, start, size, key = pieces([r[4] for r in rows])
        docs, segments = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        return batch_of(schema, key.view(np.int64), docs[text], segments[text] << 33 | start << 17 | size)

    for batch in batches:
        rows, chars = [], 0
        for row in _segmented(batch):
            rows.append(row)
            chars += len(row[4])
            if chars > 1 << 17:
                yield made(rows)
                rows, chars = [], 0
        if rows:
            yield made(rows)


def stretches(places: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one characters of the matches that adjacent linked pieces make; places are sorted."""
    if not len(places):
        return places, places
    start, size = (places >> 17) & 0xFFFF, places & 0x1FFFF
    joined = (links[1:] == links[:-1]) & (start[1:] == start[:-1] + size[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    last = np.append(first[1:], len(places)) - 1
    return start[first], start[last] + size[last]


def parsed(texts: list[str], owners: list[int], matches: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """For each text of a block: phrases found in the block or of one unknown character, longer phrases found in the corpus, characters of other owners.

    matches: for each text its stretches found in the corpus.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.zeros(0x110000, bool)
    used[points] = True
    symbols = np.cumsum(used)[points]
    symbols[first[1:] - 1] = 0  # between texts, below all characters
    names = np.repeat(np.array(owners, np.int64), lengths + 1)
    depth = longest_matches(symbols, int(used.sum()).bit_length() or 1, names)
    place = np.arange(len(points))
    ends = np.repeat(first[1:] - 1, lengths + 1)
    reach = 2 * np.minimum(np.maximum(place + depth, place + 1), np.maximum(ends, place + 1))
    for base, (starts, stops) in zip(first.tolist(), matches):
        for a, b in zip((starts + base).tolist(), (stops + base).tolist()):
            np.maximum(reach[a:b], 2 * b + 1, out=reach[a:b], where=reach[a:b] < 2 * b)
    total, out, of = int(lengths.sum()), [], {}
    for owner, n in zip(owners, lengths.tolist()):
        of[owner] = of.get(owner, 0) + n
    for i, n in enumerate(lengths.tolist()):
        base = int(first[i])
        jump, at, count, known = (reach[base : base + n] - 2 * base).tolist(), 0, 0, 0
        while at < n:
            value = jump[at]
            count += 1
            known += value & 1
            at = value >> 1
        out.append((count - known, known, total - of[owners[i]]))
    return out


_PARSED = pa.schema([("doc", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("copies", pa.int64()), ("n", pa.int64()), ("near", pa.int64()), ("far", pa.int64()), ("own", pa.int64()), ("reference", pa.int64()), ("cross_bits", pa.float64()), ("own_bits", pa.float64())])
_PARSED_KIND = ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'long'}" for f in _PARSED)


def _parse(block: int, corpus: int):
    """Rows sorted by group, document and segment, each text before its linked pieces: parses whole blocks."""

    def done(rows):
        if not rows:
            return batch_of(_PARSED, *[[] for _ in _PARSED])
        found = []
        for row in rows:
            places, at = np.unique(np.concatenate([np.zeros(0, np.int64), *row[5]]), return_index=True)
            found.append(stretches(places, np.concatenate([np.zeros(0, np.int64), *row[6]])[at]))
        counts = parsed([r[4] for r in rows], [r[0] for r in rows], found)
        out: list[list] = [[] for _ in _PARSED]
        for row, (near, far, reference) in zip(rows, counts):
            n, own = len(row[4]), own_phrases(row[4])
            cross = near * math.log2(max(reference, n) + 1) + far * math.log2(corpus + 1)
            for column, value in zip(out, (*row[:4], n, near, far, own, reference, cross, own_bits(own))):
                column.append(value)
        return batch_of(_PARSED, *out)

    def run(batches):
        group, rows, chars = None, [], 0
        gc.disable()  # tries are trees of dicts without cycles
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                texts = batch.column("text")
                heads = np.flatnonzero(np.asarray(texts.is_valid()))
                places, links = (batch.column(c).fill_null(0).to_numpy() for c in ("place", "link"))
                borders = [*heads.tolist(), batch.num_rows]
                if borders[0] and rows:
                    rows[-1][5].append(places[: borders[0]].copy())
                    rows[-1][6].append(links[: borders[0]].copy())
                heads = batch.take(pa.array(heads)).to_pydict()
                for i, row in enumerate(zip(*[heads[c] for c in ("doc", "segment", "doc_id", "copies", "text")])):
                    if rows and group == heads["group"][i] and rows[-1][:2] == list(row[:2]):
                        rows[-1][3] += row[3]
                    else:
                        if group != heads["group"][i] or chars >= 2 * block:
                            if rows:
                                yield done(rows)
                            group, rows, chars = heads["group"][i], [], 0
                        rows.append([*row, [], []])
                        chars += len(row[4])
                    if borders[i] + 1 < borders[i + 1]:
                        rows[-1][5].append(places[borders[i] + 1 : borders[i + 1]].copy())
                        rows[-1][6].append(links[borders[i] + 1 : borders[i + 1]].copy())
            yield done(rows)
        finally:
            gc.enable()

    return run


def _hot(rows: DataFrame, chars: int) -> DataFrame:
    """piece of each piece that a sample of the documents shows to be in too many rows for one task: HOT rows at most, about.

    The sample decides only how a piece is joined, not with what.
    """
    most = max(HOT_ROWS, chars // PIECE // HOT)
    sample = rows.where(F.pmod("doc", F.lit(SAMPLE)) == 0).mapInArrow(_pieces, "piece long, doc long, place long")
    return sample.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * SAMPLE > most).select("piece")


def _linked(rows: DataFrame, chars: int, work: Workspace) -> DataFrame:
    """doc, place, link for every piece that another document has; equal links are places of one document at one distance."""
    found = rows.mapInArrow(_pieces, "piece long, doc long, place long")
    # a document's hash and a place in it in one number: the least and the greatest are the places that the others are linked with
    found = found.withColumn("at", F.col("doc").bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.shiftright("place", 17).bitwiseAND(F.lit(_LOW))))
    hot = work.save(_hot(rows, chars), "hot")
    ends = F.lit(None).cast("struct<low: bigint, high: bigint>")
    if hot.limit(1).count():
        # known before the shuffle, where the partial aggregation leaves a row of each task; their rows are spread then
        hot = work.save(found.join(F.broadcast(hot), "piece", "left_semi").groupBy("piece").agg(F.min("at").alias("low"), F.max("at").alias("high")), "hot")
        found = found.join(F.broadcast(hot), "piece", "left").withColumn("known", F.when(F.col("low").isNotNull(), F.struct("low", "high"))).drop("low", "high")
        found, ends = found.withColumn("piece", F.when(F.col("known").isNull(), F.col("piece")).otherwise(F.xxhash64("doc", "place"))), F.col("known")
    by_piece = Window.partitionBy("piece")
    found = found.withColumn("ends", F.coalesce(ends, F.struct(F.min("at").over(by_piece).alias("low"), F.max("at").over(by_piece).alias("high"))))
    found = found.where(F.shiftright("ends.low", 20) != F.shiftright("ends.high", 20))
    source = F.when(F.shiftright("ends.low", 20) == F.shiftright("at", 20), F.col("ends.high")).otherwise(F.col("ends.low"))
    distance = (source.bitwiseAND(F.lit(_LOW)) - F.col("at").bitwiseAND(F.lit(_LOW))).bitwiseAND(F.lit(_LOW))
    return found.select("doc", "place", source.bitwiseAND(F.lit(~_LOW)).bitwiseOR(distance).alias("link"))


def scored(docs: DataFrame, block: int = BLOCK, work: Workspace | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_chars, cross_phrases, corpus_phrases,
    own_phrases, reference_chars, corpus_chars, score (bits per character), corpus_mean, z_score.

    cross_phrases are all phrases against the corpus, corpus_phrases those of them that are found
    by pieces and longer than any in the text's block. reference_chars are the characters of other
    documents in its block (of its segments' blocks), corpus_chars those of all documents, which the pieces cover.
    corpus_mean and z_score relate a score to the mean and standard deviation over all documents with a text.

    A null or empty text has no phrases, score 0 and z_score null. Rows of one id and text are one
    document, no other one for each other, and each has a row of the result; different texts of one id
    or without id are different documents. Texts longer than SEGMENT are parsed in segments: a phrase
    ends where a segment ends, and both kinds of phrases are counted by segments. An empty table gives no
    rows; a document alone has a phrase for each character. Of equally long matches it does not
    matter which is taken. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = work or Workspace(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of()).select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text")
    chars = rows.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    groups, n = max(1, round(chars / block)), partitions(spark)
    texts = rows.mapInArrow(_segments, "doc long, segment long, doc_id long, copies long, text string")
    texts = texts.withColumns({"place": F.lit(None).cast("long"), "link": F.lit(None).cast("long")})
    links = _linked(rows, chars, work).select("doc", F.shiftright("place", 33).alias("segment"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("copies"), F.lit(None).cast("string").alias("text"), "place", "link")
    dealt = texts.unionByName(links).withColumn("group", F.pmod(F.xxhash64("doc", "segment"), F.lit(groups)).cast("int"))
    dealt = dealt.repartitionById(n, F.pmod("group", F.lit(n))).sortWithinPartitions("group", "doc", "segment", F.asc_nulls_first("place"))
    found = dealt.mapInArrow(_parse(block, chars), _PARSED_KIND)
    total = {c: F.sum(c).alias(c) for c in ("n", "near", "far", "own", "reference", "cross_bits", "own_bits")}
    found = found.groupBy("doc", "doc_id").agg(*total.values(), F.sum(F.when(F.col("segment") == 0, F.col("copies"))).alias("copies"))
    score = F.when(F.col("n") > 0, (F.col("cross_bits") - F.col("own_bits")) / F.col("n")).otherwise(0.0)
    found = found.select("doc_id", F.col("n").alias("n_chars"), (F.col("near") + F.col("far")).alias("cross_phrases"), F.col("far").alias("corpus_phrases"), F.col("own").alias("own_phrases"), F.col("reference").alias("reference_chars"), F.lit(chars).cast("long").alias("corpus_chars"), score.alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    found = work.save(found.drop("copy"), "scores")
    own = found.where("n_chars > 0").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
    spread = own["s"] or None
    return found.withColumns({"corpus_mean": F.lit(own["m"]).cast("double"), "z_score": F.when(F.col("n_chars") > 0, (F.col("score") - F.lit(own["m"])) / F.lit(spread)).cast("double")})


def against(docs: DataFrame, reference: str) -> DataFrame:
    """doc_id, n_chars, cross_phrases, own_phrases, score of each row of docs(doc_id, text) against a given reference text.

    The reference's suffix automaton is built once in every task, so its length is bounded by
    REFERENCE. Null and empty texts score 0; against an empty reference every character is a phrase.
    """
    if len(reference) > REFERENCE:
        raise ValueError(f"a reference text has at most {REFERENCE} characters; score a corpus against itself with scored()")
    spark = docs.sparkSession
    small_batches(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("cross_phrases", pa.int64()), ("own_phrases", pa.int64()), ("score", pa.float64())])

    def run(batches):
        start = automaton(reference)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, cross, own = len(text), cross_phrases(text, start), own_phrases(text)
                rows.append((doc_id, n, cross, own, (cross * math.log2(max(len(reference), n) + 1) - own_bits(own)) / n if n else 0.0))
            yield batch_of(schema, *(zip(*rows) if rows else [[] for _ in schema]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of()).mapInArrow(run, "doc_id long, n_chars long, cross_phrases long, own_phrases long, score double")
