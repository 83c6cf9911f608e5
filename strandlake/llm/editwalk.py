"""Document fingerprints by randomised edit embedding.

The embedding (Chakraborty, Goldenberg, Koucky: Streaming algorithms for embedding
and computing edit distance, 2016) walks through a text with random bits that all
texts share: at step j it writes the character it stands on and moves on if bit j of
that character is 1. Walks of texts that differ by k edits meet again soon after each,
so the Hamming distance of what they write is of the order of k at least and k**2 at
most. The walk stands on a character until the next 1 bit of it, so it is taken from
character to character, many texts at a time.

A fingerprint samples SAMPLES steps. Each sample follows its own shared random
order of all steps and takes the first in it that the walk reached, so texts of
equal length are sampled at the same steps, and texts of lengths p < q agree on a
step with probability p / q. The sampled character is hashed to four bits, one hex
digit. The likeness of two fingerprints is the share of equal digits, corrected for
the one in sixteen that agree by chance. A band is DIGITS sampled steps; texts that share
one are candidates, and are verified by the edit distance of whole texts.

Near duplicates in the whole corpus: one walk of a long text with edits all over drifts too
far for the digits of its end to meet. So the walk is started anew at every place, for
STEPS steps of which a shared sample is one key: an edit changes the few keys of walks that
cross it, wherever it is, and texts at a distance of 5 % keep about 0.7 of them. Classes of
equal texts meet in bands of a sketch of their keys; candidates are verified by the
edit distance of whole texts (see neardup.linked).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Workspace, batch_of, partitions, small_batches, text_of
from strandlake.llm.neardup import band_keys, classes_of, keyed, linked, sketches
from strandlake.llm.wordhash import mix

SAMPLES = 256
#: Steps for which there are tables of random bits. In each further period every character takes the
#: bits of another one, so that its own don't repeat. The last bits are 1: no stay crosses a border.
PERIOD = 1 << 13
#: Digits of a band of a fingerprint.
DIGITS = 8
#: Texts that walk together, in characters.
WALK_CHARS = 3_000_000
#: With fewer texts than this still walking, one after the other is faster.
FEW = 24


def _tables():
    rng = np.random.default_rng(77)
    bits = rng.integers(0, 2, (256, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    stay = np.ones((256, PERIOD), np.uint8)  # steps until the walk has left the character
    for j in range(PERIOD - 2, -1, -1):
        stay[:, j] = np.where(bits[:, j] == 1, 1, np.minimum(stay[:, j + 1], 254) + 1)
    turn = rng.integers(0, 256, 1 << 16)  # whose bits the characters take in each period
    turn[0] = 0
    records = np.full((SAMPLES, 96), np.iinfo(np.int64).max)
    for s in range(SAMPLES):  # steps that are the first so far in the sample's order
        at, least = 0, rng.random()
        for r in range(96):
            records[s, r] = at
            gap = np.log(1 - rng.random()) / np.log1p(-least)
            if at + gap > 2**60:
                break
            at, least = at + 1 + int(gap), least * rng.random()
            if least < 1e-300:
                break
    return bits, stay, turn * PERIOD, records


_BITS, _STAY, _TURN, _RECORDS = _tables()
_ROWS = [row.tobytes() for row in _STAY]
_SHIFT, _TURNS = PERIOD.bit_length() - 1, len(_TURN) - 1
_SALTS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))
EMPTY = "0" * SAMPLES


def walks(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its code points and the step at which the walk has left each of them."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(points[i]))
    lengths = np.array([len(points[i]) for i in order], np.int64)
    out = [np.zeros(len(p), np.int64) for p in points]
    if not len(order) or not lengths[0]:
        return list(zip(points, out))
    kinds = [(mix(p.astype(np.uint64)) & np.uint64(255)).astype(np.uint8) for p in points]
    together = int(lengths[FEW - 1]) if len(order) >= FEW else 0
    going = np.searchsorted(-lengths, -np.arange(1, together + 1), "right")  # texts at each character, longest first
    base = np.concatenate([[0], np.cumsum(going)])
    flat, left = np.empty(base[-1], np.int32), np.empty(base[-1], np.int64)
    places = []
    for rank, i in enumerate(order):
        n = min(len(points[i]), together)
        places.append(base[:n] + rank)
        flat[places[-1]] = kinds[i][:n].astype(np.int32) * PERIOD
    stay, at, mask, turns = _STAY.reshape(-1), np.zeros(len(order), np.int64), PERIOD - 1, (_TURN >> _SHIFT).tolist()
    for j in range(together):
        now = at[: going[j]]
        now += stay[(flat[base[j] : base[j + 1]] ^ _TURN[(now >> _SHIFT) & _TURNS]) + (now & mask)]
        left[base[j] : base[j + 1]] = now
    for rank, i in enumerate(order):
        n = len(places[rank])
        out[i][:n] = left[places[rank]]
        if n < len(points[i]):
            step, rest = int(at[rank]), []
            for kind in kinds[i][n:].tobytes():
                step += _ROWS[kind ^ turns[(step >> _SHIFT) & _TURNS]][step & mask]
                rest.append(step)
            out[i][n:] = rest
    return list(zip(points, out))


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of SAMPLES values from 0 to 15 for each text; zeros for an empty text."""
    out = np.zeros((len(texts), SAMPLES), np.uint8)
    for i, (points, left) in enumerate(walks(texts)):
        if len(points):
            sampled = _RECORDS[np.arange(SAMPLES), (_RECORDS < left[-1]).sum(1) - 1]
            chars = points[np.searchsorted(left, sampled, "right")].astype(np.uint64)
            out[i] = (mix(chars * np.uint64(0x9E3779B97F4A7C15) ^ _SALTS) & np.uint64(15)).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return max(0.0, (float((a == b).mean()) - 1 / 16) * 16 / 15)


def shared_bands(a: np.ndarray, b: np.ndarray) -> int:
    """Bands in which two fingerprints agree."""
    return int((a == b).reshape(-1, DIGITS).all(1).sum())


def text_form(fingerprint: np.ndarray) -> str:
    return "".join("0123456789abcdef"[v] for v in fingerprint.tolist())


def _compare(batches):
    """Rows in the order of their bucket: every text against the one after it. Rows with own = 1 only follow."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("bands_edited", pa.int32()), ("bands_next", pa.int32()), ("edits_next", pa.int64())])

    def done(rows):
        """The rows but the last, which waits for the one that follows."""
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[2]]
        edited = []
        for (_, _, _, text), (_, _, _, follower) in pairs:
            half = len(text) // 2
            edited.append(text[: len(text) - half] + follower[:half])
        made = fingerprints([r[3] for r in rows] + edited)
        own = {id(r): f for r, f in zip(rows, made)}
        columns: list[list] = [[] for _ in schema]
        for (a, b), new, mark in zip(pairs, edited, made[len(rows) :]):
            f, g = own[id(a)], own[id(b)]
            for column, value in zip(columns, (a[1], len(a[3]), hashlib.sha256(new.encode()).hexdigest(), text_form(f), text_form(mark), likeness(f, mark), likeness(f, g), shared_bands(f, mark), (shared := shared_bands(f, g)), edit_distance(a[3], b[3]) if shared else None)):
                column.append(value)
        return batch_of(schema, *columns)

    rows, chars = [], 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("bucket", "doc_id", "own", "text")]):
            rows.append(row)
            chars += len(row[3])
            if chars >= WALK_CHARS:
                yield done(rows)
                rows, chars = rows[-1:], len(rows[-1][3])
    yield done(rows)


def _ranges(rows: DataFrame, n: int):
    """The bucket of each row of rows(doc_id, tie, text) by ranges of (doc_id descending, tie), n at most and about equal.

    An id that holds several quantiles is split by its tie, which is a hash.
    """
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit((i + 1) / n) for i in range(n - 1)]), F.lit(10_000)).alias("q")).first()["q"] if n > 1 else None
    weight: dict[int, int] = {}
    for c in cuts or []:
        weight[c] = weight.get(c, 0) + 1
    bucket = F.lit(0)
    if len(weight) > 64:
        both = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(k).alias("k")) for c, k in weight.items()])
        bucket = F.aggregate(both, F.lit(0), lambda total, x: total + F.when(F.col("doc_id") <= x["c"], x["k"]).otherwise(0))
    else:
        for c, k in weight.items():
            bucket = bucket + F.when(F.col("doc_id") <= c, k).otherwise(0)
    for c, k in weight.items():  # fewer ids than quantiles can hold two of them
        if k > 1:
            part = F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * k), F.lit(k - 1)).cast("int")
            bucket = bucket - F.when(F.col("doc_id") == c, k - 1 - part).otherwise(0)
    return bucket.cast("int")


def fingerprinted(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_chars (code points), edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, bands_edited, bands_next, edits_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document, by descending doc_id; after the last comes the first.
    near_edited and near_next are the likeness of the document's fingerprint to those of its
    edited text and of the next document, bands_edited and bands_next the bands they share;
    edits_next verifies a next document that shares a band: its edit distance, else null.

    A null text is empty; an empty text has the fingerprint of zeros. Rows of one id follow each
    other by a hash of the text; a null id comes last, rows without id as rows of one id. A single
    row is its own next. Texts of any length are walked whole; verification of two alike texts
    takes time as the product of the lengths that lie between their common start and
    end. An empty table gives no rows; other columns are ignored.

    Texts are shuffled once: by ranges of doc_id whose bounds come from a quantile sketch (and for
    an id that many rows have, of the hash). The first row of each range is also sent to the range
    before, for which only the first id and hash of each range come to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    least = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc_id"), text_of()).withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("bucket", _ranges(rows, n))
    first = sorted((r["bucket"], *r["top"]) for r in rows.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("tie").alias("tie"))).alias("top")).collect())
    targets = F.lit(None).cast("int")
    if first:
        before = [first[-1][0], *(b for b, _, _ in first)]
        tops = F.create_map(*[x for (b, i, t), to in zip(first, before) for x in (F.lit(b), F.struct(F.lit(i).cast("long").alias("id"), F.lit(t).cast("long").alias("tie"), F.lit(to).alias("to")))])
        own = F.element_at(tops, F.col("bucket"))
        targets = F.when((F.col("doc_id") == own["id"]) & (F.bitwise_not("tie") == own["tie"]), own["to"])
    both = F.when(targets.isNull(), F.array(F.struct(F.col("bucket").alias("to"), F.lit(0).alias("own")))).otherwise(F.array(F.struct(F.col("bucket").alias("to"), F.lit(0).alias("own")), F.struct(targets.alias("to"), F.lit(1).alias("own"))))
    sent = rows.select("doc_id", "tie", "text", F.explode(both).alias("x")).select(F.col("x.to").alias("bucket"), F.col("x.own").alias("own"), "doc_id", "tie", "text")
    sent = sent.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "own", F.desc("doc_id"), "tie", "text")
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int, edits_next long"
    return sent.drop("tie").mapInArrow(_compare, kind).withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, by Myers' bit vectors in big integers between the common start and end."""
    if len(a) > len(b):
        a, b = b, a
    if b.startswith(a) or b.endswith(a):
        return len(b) - len(a)
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    start = int((x != y[: len(x)]).argmax())  # they differ somewhere
    end = min(int((x[::-1] != y[::-1][: len(x)]).argmax()), len(x) - start)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    m = len(a)
    if not m:
        return len(b)
    full, top, match = (1 << m) - 1, 1 << (m - 1), {}
    for i, c in enumerate(a):
        match[c] = match.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    for c in b:
        eq = match.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, wrong = down | ~(diagonal | up) & full, up & diagonal
        if right & top:
            score += 1
        elif wrong & top:
            score -= 1
        right, wrong = (right << 1 | 1) & full, wrong << 1 & full
        up, down = wrong | ~(diagonal | right) & full, right & diagonal
    return score


#: Steps of a walk from a place, which stays two on a character on average, and those that are sampled.
STEPS, SAMPLED = 14, (0, 1, 3, 4, 6, 8, 10, 12)
BANDS, WIDTH = 128, 4


def agreement(percent: int) -> float:
    """Least agreement of two sketches for texts of which percent % are equal: half their expected similarity."""
    kept = (percent / 100) ** (STEPS // 2)
    return kept / (2 - kept) / 2


def local_walks(text: str) -> np.ndarray:
    """The set of keys of the walks of STEPS steps from every place but the last few; of the only one if there are not so many."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashed = np.concatenate([mix(points + np.uint64(1)), np.zeros(STEPS + 1, np.uint64)])  # zeros after the end
    kinds = (hashed & np.uint64(255)).astype(np.int64) * PERIOD
    at = np.arange(max(1, len(points) - STEPS // 2 + 1))
    key, bits = np.zeros(len(at), np.uint64), _BITS.reshape(-1)
    for step in range(STEPS):
        if step in SAMPLED:
            key = key * np.uint64(0x9E3779B97F4A7C15) + hashed[at]
        at = at + bits[kinds[at] + step]
    return np.unique(mix(key))


def _signatures(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_chars", pa.int64()), ("node", pa.binary()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        texts = batch.column("text").to_pylist()
        node = [hashlib.blake2b(t.encode(), digest_size=16).digest() if t else None for t in texts]
        sketch, bands = [None] * len(texts), [None] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        for at in range(0, len(full), 64):
            made = sketches([local_walks(texts[i]) for i in full[at : at + 64]], BANDS * WIDTH)
            coarse, keys = (mix(made) & np.uint64(255)).astype(np.uint8), band_keys(made, BANDS).view(np.int64)
            for k, i in enumerate(full[at : at + 64]):
                sketch[i], bands[i] = coarse[k].tobytes(), keys[k]
        yield batch_of(schema, batch.column("doc_id"), batch.column("text_key"), [len(t) for t in texts], node, sketch, bands)


def _verify(percent: int):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        key, pivot = None, ""
        for batch in batches:
            a_out, b_out = [], []
            for a, salt, role, node, text in zip(*[batch.column(c).to_pylist() for c in ("a", "salt", "role", "node", "text")]):
                if hashlib.blake2b(text.encode(), digest_size=16).digest() != node:
                    continue
                if role == 0:
                    key, pivot = (a, salt), text
                elif key == (a, salt):
                    longer = max(len(pivot), len(text))
                    if 100 * abs(len(pivot) - len(text)) <= (100 - percent) * longer and 100 * edit_distance(pivot, text) <= (100 - percent) * longer:
                        a_out.append(a)
                        b_out.append(node)
            yield batch_of(schema, a_out, b_out)

    return run


def near_by_edits(docs: DataFrame, percent: int = 95, work: Workspace | None = None) -> DataFrame:
    """doc_id, component_id for each row of docs(doc_id, text): documents linked where the edit
    distance is at most (100 - percent) % of the longer text; component_id is the least id reached.

    Empty and null texts are linked with nothing. Rows of one id are judged each by its own text; a null
    id counts as a document of its own text, and where it is all a component has component_id is null. An
    empty table gives no rows; other columns are ignored. Candidates are texts whose sketches share a
    band and agree enough, so the recall is high at 95 % and above (see the README) but, unlike
    the verification, not exact; the bands are laid out for that and lose more below.
    """
    small_batches(docs.sparkSession)
    work = work or Workspace(docs.sparkSession)
    signed = work.save(keyed(docs).mapInArrow(_signatures, "doc_id long, text_key long, n_chars long, node binary, sketch binary, bands array<long>"), "signatures")
    classes = work.save(classes_of(signed), "classes")
    roots = linked(docs, classes, _verify(percent), agreement(percent), work)
    named = classes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = work.save(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return signed.select("doc_id", "node").join(named.join(least, "root").select("node", "component_id"), "node", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
