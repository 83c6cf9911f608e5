"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of about PASSAGE bytes, together its whole text.
Every passage is encoded: shares of byte kinds, hashed byte pairs and word repetition
statistics are standardised and projected to h = tanh(W x + b). The gated attention
(Ilse, Tomczak, Welling: Attention-based deep multiple instance learning, 2018)
a = softmax(w . (tanh(V h) * sigmoid(U h))) weighs the passages, and the document's
score is sigmoid(c . sum(a h) + d). All parameters are learnt together from document
labels only, by Adam on the cross-entropy.

Fitting takes the rows of at most FIT_ROWS labelled ids (a documented bound: 4,000, those with
the least seeded hash; of more rows than twice that, a sample), and of a document of over FIT_PASSAGES passages (64)
so many, spread evenly over it: attention weighs shares, so an even sample stands for the
whole. Every document is scored from all of its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import batch_of, small_batches, text_of
from strandlake.llm.wordhash import BLANK_SEPARATED, Words, byte_slices, string_buffers

PASSAGE, FIT_ROWS, FIT_PASSAGES = 1000, 4000, 64
HIDDEN, GATE = 24, 12
#: Bytes of text that are encoded together, at some hundred bytes of memory each.
SLICE = 1 << 20
THRESHOLD = 0.3
_PAIRS = 64


def _kinds() -> np.ndarray:
    """A kind for every byte: each ASCII sign its own, then upper, lower, digits, blanks, controls, non-ASCII."""
    kinds, signs = np.zeros(256, np.int64), 0
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            kinds[b] = 37 if b < 0xC0 else 38
        elif c.isupper():
            kinds[b] = 32
        elif c.islower():
            kinds[b] = 33
        elif c.isdigit():
            kinds[b] = 34
        elif c == " ":
            kinds[b] = 35
        elif b < 0x20 or b == 0x7F:
            kinds[b] = 36
        else:
            kinds[b], signs = signs, signs + 1
    return kinds


_KINDS = _kinds()
N_KINDS = 39
WIDTH = N_KINDS + _PAIRS + 4


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text); an empty text has one of zeros."""
    lengths = np.diff(offsets)
    numbers = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate([[0], np.cumsum(numbers)])
    n = int(first[-1])
    # cut each text into that many nearly equal passages
    nth = np.arange(n) - np.repeat(first[:-1], numbers)
    starts = np.repeat(offsets[:-1], numbers) + np.repeat(lengths, numbers) * nth // np.repeat(numbers, numbers)
    sizes = np.diff(np.concatenate([starts, offsets[-1:]]))
    of = np.repeat(np.arange(n), sizes)
    out = np.zeros((n, WIDTH), np.float32)
    scale = np.maximum(sizes, 1)[:, None]
    out[:, :N_KINDS] = np.sqrt(np.bincount(of * N_KINDS + _KINDS[data], minlength=n * N_KINDS).reshape(n, -1) / scale)
    pair = ((data[:-1].astype(np.uint32) * np.uint32(2654435761) + data[1:] * np.uint32(40503 * 65537)) >> np.uint32(26)).astype(np.int64)
    if len(pair):
        out[:, N_KINDS : N_KINDS + _PAIRS] = np.sqrt(np.bincount(of[:-1] * _PAIRS + pair, minlength=n * _PAIRS).reshape(n, -1) / scale)
    words = Words(data, offsets, BLANK_SEPARATED)
    k = len(words.hash)
    if k:
        at = of[words.start]
        count = np.maximum(np.bincount(at, minlength=n), 1)
        same = np.zeros(k, bool)
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (at[1:] == at[:-1])
        distinct = np.zeros(n)
        order = np.lexsort((words.hash, at))
        new = np.ones(k, bool)
        new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (at[order][1:] != at[order][:-1])
        np.add.at(distinct, at[order][new], 1)
        out[:, -4] = np.bincount(at, same, n) / count
        out[:, -3] = distinct / count
        out[:, -2] = np.log1p(np.bincount(at, words.end - words.start, n) / count)
        out[:, -1] = np.log1p(np.bincount(at, minlength=n) * 100 / scale[:, 0])
    return out, numbers


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Attention:
    """Gated attention over bags of encoded passages."""

    def __init__(self, width: int = WIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.mean, self.scale, self.base = np.zeros(width), np.ones(width), None
        self.p = {"W": g(width, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE), "w": g(GATE), "c": g(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, numbers: np.ndarray) -> tuple:
        """Scores and what the gradient needs; x is standardised, numbers are passages of each bag, 1 at least."""
        p, starts = self.p, np.concatenate([[0], np.cumsum(numbers)[:-1]])
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), numbers))
        a = e / np.repeat(np.add.reduceat(e, starts), numbers)
        z = np.add.reduceat(a[:, None] * h, starts)
        return _sigmoid(z @ p["c"] + p["d"]), h, t, s, a, z, starts

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def score(self, x: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(numbers), self.base)
        return self.forward(self.standard(x), numbers)[0]

    def fit(self, x: np.ndarray, numbers: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, batch: int = 256, decay: float = 1e-4) -> "Attention":
        """Learn from labels 0 and 1. Without both kinds the score is their mean everywhere (0.5 without any)."""
        if len(set(y.tolist())) < 2:
            self.base = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x, first = self.standard(x), np.concatenate([[0], np.cumsum(numbers)])
        rng, step = np.random.default_rng(3), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                bags = order[at : at + batch]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in bags])
                grad = self._gradient(x[rows], numbers[bags], y[bags], decay)
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - now * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x, numbers, y, decay) -> dict:
        p = self.p
        out, h, t, s, a, z, starts = self.forward(x, numbers)
        g = (out - y) / len(y)
        gz = np.repeat(g[:, None] * p["c"], numbers, 0)
        ga = (gz * h).sum(1)
        ge = a * (ga - np.repeat(np.add.reduceat(a * ga, starts), numbers))
        gts = ge[:, None] * p["w"]
        gt, gs = gts * s * (1 - t * t), gts * t * s * (1 - s)
        gh = (a[:, None] * gz + gt @ p["V"].T + gs @ p["U"].T) * (1 - h * h)
        grad = {"W": x.T @ gh, "b": gh.sum(0), "V": h.T @ gt, "U": h.T @ gs, "w": (t * s).T @ ge, "c": z.T @ g, "d": np.array([g.sum()])}
        return {k: v + decay * p[k] * (k not in "bd") for k, v in grad.items()}


def spread(n: int) -> np.ndarray:
    """All of n passages, or FIT_PASSAGES of them at even distances."""
    return np.arange(n) if n <= FIT_PASSAGES else (np.arange(FIT_PASSAGES) * 2 + 1) * n // (2 * FIT_PASSAGES)


def _encoded(batches):
    schema = pa.schema([("label", pa.float64()), ("passages", pa.int64()), ("features", pa.binary())])
    for batch in batches:
        data, offsets = string_buffers(batch.column("text"))
        for a, b in byte_slices(offsets, SLICE):
            x, numbers = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ends = np.cumsum(numbers)
            taken = [spread(int(n)) for n in numbers]
            yield batch_of(schema, batch.column("label").slice(a, b - a), [len(t) for t in taken], [x[end - n + t].tobytes() for end, n, t in zip(ends, numbers, taken)])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Attention:
    """The model learnt from labels(doc_id, quality) and the texts of docs(doc_id, text).

    Labels whose quality is null are left out; several labels of one id count as their majority
    (a tie as 1). Rows of docs that repeat an id are all learnt with its label, unless the ids
    chosen have over 2 * fit_rows rows: then fit_rows of them in expectation are, by a hash of the row's place.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.when(F.avg(F.col("quality").cast("double")) >= 0.5, 1.0).otherwise(0.0).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of())
    n = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(chosen), "doc_id", "left_semi").count()
    texts = texts.join(F.broadcast(chosen), "doc_id")
    if n > 2 * fit_rows:
        texts = texts.where(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1_000_000)) < F.lit(int(1_000_000 * fit_rows / n)))
    rows = texts.select("label", "text").mapInArrow(_encoded, "label double, passages long, features binary").collect()
    rows = sorted((r["label"], r["passages"], bytes(r["features"])) for r in rows)
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, WIDTH).astype(np.float64)
    return Attention().fit(x, np.array([r[1] for r in rows], np.int64), np.array([r[0] for r in rows]))


def _score(shared, n_carried: int, schema: pa.Schema):
    def run(batches):
        model = shared.value
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for a, b in byte_slices(offsets, SLICE):
                score = model.score(*encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                columns = [batch.column(f"c{i}").slice(a, b - a) for i in range(n_carried)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip([*columns, score], schema)], schema=schema)

    return run


def score(docs: DataFrame, model: Attention, columns: list[str] | None = None) -> DataFrame:
    """docs with the columns named (all by default) and score, from 0 to 1, after them.

    A null or empty text is one passage of zeros and has the score the model gives that; a very
    long text is one bag of all its passages. Equal texts have equal scores (ties are not broken). Repeated
    rows are scored each; an empty table gives no rows; columns may have any names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    columns = docs.columns if columns is None else columns
    out = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)] + ["score double"])
    schema = to_arrow_schema(spark.createDataFrame([], out).schema)
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], text_of())
    shared = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(shared, len(columns), schema), out).toDF(*columns, "score")
