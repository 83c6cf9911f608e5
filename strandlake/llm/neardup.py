"""MinHash near-duplicates by fast similarity sketching.

The sketch (Dahlgaard, Knudsen, Thorup: Fast Similarity Sketching, 2017) has T
bins. In round i < T every element picks a random bin and a value in [i, i+1); in
round T+i every element goes to bin i. A bin keeps its least value, and the rounds
end when no bin is empty, which is certain after 2T rounds and usual after one or
two. Two sketches agree in a bin with the Jaccard similarity of the sets, with the
concentration of T independent samples, at a cost of O(T log T + n).

Plan:
1. One pass over the texts gives each document its set size, a 128-bit digest of
   its set, the sketch and the band keys. Texts and sets are not shuffled.
2. Documents of one digest have one set: they form a class, and only classes go on.
   So a group of copies is one row after a map-side aggregation, whatever its size.
3. Classes meet in band buckets. Every bucket is cut into blocks of at most BLOCK
   members. First, each member is compared with the first of its block only; the
   candidates' sketches must agree enough, and the survivors are confirmed on the
   full sets. That joins most of a family with a number of pairs linear in it.
4. Buckets that then hold several components are searched again: members of
   different components, block against block, so that no task holds more than two
   blocks, and again confirmed on full sets. Pairs inside one component are not
   needed for the components and never made. No bucket is capped or dropped.
5. Components of the confirmed links, by label propagation.

Any two classes of similarity >= 0.8 share a band except with a chance below
(1 - 0.8**5)**32 = 3e-6, and the sketch filter (agreement >= 0.62, that is 5.6
standard deviations below 0.8) loses less than that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Workspace, batch_of, partitions, small_batches, text_of
from strandlake.llm.components import components
from strandlake.llm.wordhash import BLANK_SEPARATED, Words, byte_slices, mix, shingle_sets, string_buffers

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Least agreement of two sketches for a candidate of similarity 0.8.
AGREE = 0.62
#: Most members of a bucket that are held together.
BLOCK = 4096

_ROUND = np.uint64(55)


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches of non-empty sets of 64-bit hashes, one row each."""
    out = np.full(len(sets) * bins, np.uint64(2**64 - 1))
    if not sets:
        return out.reshape(0, bins)
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * bins):
        h = mix(elements ^ mix(np.array([i + 1], np.uint64))[0])
        value = (np.uint64(i) << _ROUND) | (h >> np.uint64(64 - 55))
        at = ((h & np.uint64(0x7FFFFFFF)) * np.uint64(bins) >> np.uint64(31)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out, owner * bins + at, value)
        lacking = (out.reshape(-1, bins) == np.uint64(2**64 - 1)).any(1)
        if not lacking.any():
            break
        go = lacking[owner]
        elements, owner = elements[go], owner[go]
    return out.reshape(-1, bins)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band, different for different bands."""
    rows = sketch.reshape(len(sketch), bands, sketch.shape[1] // bands)
    key = np.zeros(rows.shape[:2], np.uint64)
    for j in range(rows.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return mix(key + np.arange(1, bands + 1, dtype=np.uint64))


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signatures(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            ids, own = batch.column("doc_id"), batch.column("text_key")
            for a, b in byte_slices(offsets):
                sets = shingle_sets(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BLANK_SEPARATED), shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                made = sketches([sets[i] for i in full])
                keys = band_keys(made).view(np.int64)
                coarse = (mix(made) & np.uint64(255)).astype(np.uint8)
                node, sketch, bands = [None] * (b - a), [None] * (b - a), [None] * (b - a)
                for k, i in enumerate(full):
                    node[i], sketch[i], bands[i] = digest(sets[i]), coarse[k].tobytes(), keys[k]
                yield batch_of(schema, ids.slice(a, b - a), own.slice(a, b - a), [len(s) for s in sets], node, sketch, bands)

    return run, "doc_id long, text_key long, n_shingles long, node binary, sketch binary, bands array<long>"


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _first_of_block(batches, agree: float):
    """Rows sorted by bucket and block: pair every member with the first of its block, if the sketches agree."""
    key, pivot, view = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("key").to_pylist(), batch.column("block").to_pylist()))
        nodes = batch.column("node").to_pylist()
        flat = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(nodes), -1)
        pivots, rows = [], []
        left = np.empty_like(flat)
        for i, k in enumerate(keys):
            if k != key:
                key, pivot, view = k, nodes[i], flat[i].copy()
            else:
                rows.append(i)
                pivots.append(pivot)
            left[i] = view
        index = np.array(rows, np.int64)
        good = (flat[index] == left[index]).mean(1) >= agree if len(index) else []
        yield batch_of(_PAIR, [p for p, g in zip(pivots, good) if g], [nodes[i] for i, g in zip(rows, good) if g])


def _across(batches, agree: float):
    """Rows sorted by bucket and pair of blocks: pairs of members of different components, if the sketches agree."""

    def pairs(group):
        if not group:
            return
        nodes, roots, sides = ([g[i] for g in group] for i in (0, 1, 2))
        flat = np.frombuffer(b"".join(g[3] for g in group), np.uint8).reshape(len(group), -1)
        number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        root = np.array([number[r] for r in roots])
        side = np.array(sides)
        # side 0: one block against itself; else 1 against 2
        for i in range(len(nodes)):
            other = np.flatnonzero((root != root[i]) & ((side == 2) if side[i] == 1 else (side == 0) & (np.arange(len(nodes)) > i)))
            if side[i] != 2 and len(other):
                close = other[(flat[other] == flat[i]).mean(1) >= agree].tolist()
                yield from ((nodes[i], nodes[j]) for j in close)

    def emit(found):
        return batch_of(_PAIR, [f[0] for f in found], [f[1] for f in found])

    key, group, found = None, [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "low", "high", "node", "root", "side", "sketch")]
        for k, low, high, *member in zip(*columns):
            if (k, low, high) != key:
                for p in pairs(group):
                    found.append(p)
                    if len(found) >= 10_000:
                        yield emit(found)
                        found = []
                key, group = (k, low, high), []
            group.append(member)
    for p in pairs(group):
        found.append(p)
        if len(found) >= 10_000:
            yield emit(found)
            found = []
    yield emit(found)


def _confirm(shingle: int, percent: int):
    """Rows sorted by (pivot, salt), the pivot's text first: keep the members whose full sets are near enough."""

    def run(batches):
        key, pivot = None, None
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            groups = list(zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist()))
            nodes, roles = batch.column("node").to_pylist(), batch.column("role").to_pylist()
            a_out, b_out = [], []
            for x, y in byte_slices(offsets):
                sets = shingle_sets(Words(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], BLANK_SEPARATED), shingle)
                for i, own in zip(range(x, y), sets):
                    if digest(own) != nodes[i]:  # another text under a repeated id
                        continue
                    if roles[i] == 0:
                        key, pivot = groups[i], own
                    elif key == groups[i]:
                        at = np.searchsorted(pivot, own)
                        common = int((pivot[np.minimum(at, len(pivot) - 1)] == own).sum())
                        if 100 * common >= percent * (len(pivot) + len(own) - common):
                            a_out.append(key[0])
                            b_out.append(nodes[i])
            yield batch_of(_PAIR, a_out, b_out)

    return run


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, confirm, work: Workspace) -> DataFrame:
    """The pairs(a, b) of classes that `confirm` keeps when it sees their whole texts.

    The texts come by one join on the id and hash of the class's representative, so that other
    texts of its id stay away. A pivot's pairs are cut into
    salts of some hundred members, so a hot pivot is spread over tasks; each salt
    has its own copy of the pivot's text, and members stream past it.
    """
    pairs = work.save(pairs.distinct().withColumn("salt", F.lit(0)), "pairs")
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salted = pairs.drop("salt").join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / 200)).cast("int").alias("salt"))
    wanted = salted.select("a", "salt", F.col("a").alias("node"), F.lit(0).alias("role")).distinct().union(salted.select("a", "salt", F.col("b").alias("node"), F.lit(1).alias("role")))
    wanted = wanted.join(classes.select("node", "doc_id", "text_key"), "node")
    known = F.coalesce("doc_id", F.lit(-(2**63))).alias("id")
    rows = wanted.select("*", known).drop("doc_id").join(keyed(docs).select(known, "text_key", "text"), ["id", "text_key"]).select("a", "salt", "role", "node", "text")
    rows = rows.repartition(partitions(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.mapInArrow(confirm, "a binary, b binary").distinct()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), text of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of()).select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def classes_of(signed: DataFrame) -> DataFrame:
    """One row for each node of signed: its least id with the hash of that row's text, the sketch and the bands."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    rows = signed.where("node is not null").groupBy("node").agg(first, F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    return rows.select("node", "first.doc_id", "first.text_key", "sketch", "bands")


def linked(docs: DataFrame, classes: DataFrame, confirm, agree: float, work: Workspace) -> DataFrame:
    """(node, root) of all classes(node, doc_id, text_key, sketch, bands) that have a confirmed link.

    doc_id and text_key are the class's representative among docs(doc_id, text); sketches are bytes that
    are compared place by place, bands are keys. Steps 3 to 5 of the plan above.

    The sizes of buckets, and which of them are mixed, are written tables, so both sides of a join by
    bucket are shuffles of stored rows, of which adaptive execution splits a hot bucket's.
    """
    slim = classes.select("node", "doc_id", "text_key")
    members = classes.select("node", F.explode("bands").alias("key"))
    sizes = work.save(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    buckets = work.save(members.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).select("key", "node", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "buckets")
    sketch_of = classes.select("node", "sketch")
    n = partitions(docs.sparkSession)

    starred = buckets.join(sketch_of, "node").select("key", "block", "node", "sketch")
    starred = starred.repartition(n, "key", "block").sortWithinPartitions("key", "block", "node").mapInArrow(lambda rows: _first_of_block(rows, agree), "a binary, b binary")
    links = work.save(_confirmed(docs, slim, starred, confirm, work), "links")
    roots = components(links, work)

    labelled = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    mixed = work.save(mixed, "mixed")
    labelled = labelled.join(mixed, "key").join(sketch_of, "node")
    spread = labelled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    spread = spread.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "root", side.alias("side"), "sketch")
    rest = spread.repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high", "side").mapInArrow(lambda rows: _across(rows, agree), "a binary, b binary")
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = work.save(_confirmed(docs, slim, rest, confirm, work), "links")
    return components(links.union(more), work)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, work: Workspace | None = None) -> DataFrame:
    """One row for every row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are separated by ASCII blanks after A-Z became a-z; a document's set has
    its distinct `shingle`-word windows, or its whole sequence if it has fewer words.
    Documents with 100 * |intersection| >= percent * |union| are linked, and
    component_id is the least doc_id that links reach. percent must be at least 80:
    the bands are laid out for that.

    Null or empty texts and texts of blanks have the empty set: n_shingles 0, linked
    with nothing, kept. Rows that repeat an id are judged each by its own text. A
    null id counts as a document of its own text; where it is all a component has,
    component_id is null and the row is kept. Texts are compared whole, however long. Ties (the least id
    in several rows) leave all rows of that id kept. Sets are compared by 64-bit hashes of their windows: two different
    windows of one pair of documents are taken for equal with a chance of about 2**-64. Other columns are ignored. An empty
    table gives an empty result.
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    spark = docs.sparkSession
    small_batches(spark)
    work = work or Workspace(spark)
    run, kind = _signatures(shingle)
    signed = work.save(keyed(docs).mapInArrow(run, kind), "signatures")
    classes = work.save(classes_of(signed), "classes")
    roots = linked(docs, classes, _confirm(shingle, percent), AGREE, work)
    slim = classes.select("node", "doc_id")
    named = slim.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    # stored, so that adaptive execution can split the join where one component holds many classes
    least = work.save(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    found = named.join(least, "root").select("node", "component_id")
    own = signed.select("doc_id", "n_shingles", "node").join(found, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
