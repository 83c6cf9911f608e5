"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter stands for a Bloom filter of each language: place p of
the table has a bit for every language, so combining the HASHES places of an n-gram
by AND gives at once all languages whose n-grams contain it. A text's n-grams give
each language a count of hits, from which the hits expected by chance are taken:
with f the share of places a language has set, a foreign n-gram hits with f ** HASHES.

N-grams are 2 to 4 characters long, of lower-cased letters with one blank for
everything else. A language keeps an n-gram if its rate there is at least SHARE of
the n-gram's highest rate in any language.

Fitting reads FIT_ROWS different documents in expectation of each language (those with
the least seeded hash; a documented bound: 3,000), whole, and keeps all their n-grams, of all
languages that occur. The filter is put together by the executors, place by place, and is
all that comes to the driver and goes to the workers: a bit for each language and place, with as
many places as TABLE_BYTES allow and the n-grams need. Every document is predicted from all of its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import Workspace, batch_of, small_batches, text_of
from strandlake.llm.wordhash import byte_slices, mix, string_buffers

FIT_ROWS, SHARE = 3000, 0.4
LENGTHS, HASHES = (2, 3, 4), 3
#: Most bytes of the filter, of which eight languages take one for each place.
TABLE_BYTES = 64 << 20
UNKNOWN = "und"
#: Bytes of text whose n-grams are held together, at some hundred bytes each; a longer text is read in parts.
SLICE = 1 << 17
#: Different n-grams whose counts a task holds before it passes them on.
TALLY = 1 << 18
#: The bits of each byte, lowest first.
_BITS_OF = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.float64)


def _letters() -> np.ndarray:
    """For every code point the lower-cased letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS = _letters()


def _symbols(data: np.ndarray, offsets: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters and blanks of texts in one buffer, the text of each, letters of each text). before: symbols of the first text that stand ahead of data."""
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _LETTERS[points]
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(starts))
    is_letter = low > 0
    n_letters = np.bincount(text[is_letter], minlength=len(offsets) - 1)
    # one blank for each run of other characters, and one at each end of a text
    after = np.zeros(len(low), bool)
    after[1:] = is_letter[:-1] & (text[1:] == text[:-1])
    after[:1] = len(before) and before[-1] > 0
    kept = is_letter | after
    return np.concatenate([before, low[kept]]), np.concatenate([np.zeros(len(before), np.int32), text[kept]]), n_letters


def _hashed(low: np.ndarray, text: np.ndarray, seen: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams of the symbols, the text of each), but for those within the first `seen` symbols."""
    hashes, owner = [], []
    total = low.astype(np.uint64)
    before = np.zeros(len(low), bool)  # the first letter of a word
    before[1:] = (low[:-1] == 0) | (text[1:] != text[:-1])
    before[:1] = True
    head = before & (low > 0)
    head[:seen] = False
    hashes.append(mix(total[head] + np.uint64(1 << 40)))
    owner.append(text[head])
    for n in range(2, max(LENGTHS) + 1):
        total = total[:-1] * np.uint64(0x110000) + low[n - 1 :]
        if n in LENGTHS and len(total):
            whole = (text[: len(total)] == text[n - 1 :]) & (low[: len(total)] > 0)
            whole[: max(0, seen - n + 1)] = False
            hashes.append(mix(total[whole] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)))
            owner.append(text[: len(total)][whole])
    return np.concatenate(hashes), np.concatenate(owner)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all n-grams, the text of each, letters of each text) for texts in one buffer."""
    low, text, n_letters = _symbols(data, offsets, np.zeros(0, np.uint32))
    return *_hashed(low, text, 0), n_letters


def parts(data: np.ndarray, offsets: np.ndarray):
    """What grams gives for texts of SLICE bytes in all, or for one longer text in parts of SLICE bytes: each n-gram in that where it ends."""
    if len(offsets) != 2:
        yield grams(data, offsets)
        return
    low, at = np.zeros(0, np.uint32), 0
    while True:
        end = min(at + SLICE, len(data))
        # not within a character, which has three bytes after its first at most
        end = next((p for p in range(end, end - 4, -1) if p == len(data) or data[p] & 0xC0 != 0x80), end)
        before = low[1 - max(LENGTHS) :]
        low, text, n_letters = _symbols(data[at:end], np.array([0, end - at]), before)
        yield *_hashed(low, text, len(before)), n_letters
        at = end
        if at == len(data):
            return


def places_for(languages: int, most: int) -> int:
    """A power of two: 16 places for each n-gram of the largest language, 2**20 to 2**24, but never over TABLE_BYTES in all."""
    wanted = min(max(1 << 20, 1 << (16 * most - 1).bit_length()), 1 << 24)
    slices = -(-max(1, languages) // 8)
    return min(wanted, 1 << ((TABLE_BYTES // slices).bit_length() - 1))


class Filter:
    """The bit-sliced Bloom filter of the languages' n-grams: a byte of eight languages for each place and slice."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        share = [np.bincount(column, minlength=256) @ _BITS_OF / len(column) for column in table]  # eight languages at a time
        self.chance = np.concatenate([*share, np.zeros(0)])[: len(languages)] ** HASHES

    def _places(self, hashes: np.ndarray):
        for i in range(HASHES):
            yield ((hashes >> np.uint64(20 * i)) & np.uint64(self.table.shape[1] - 1)).astype(np.int64)

    def hits(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, n-grams contained by each language) for each of n texts."""
        found = np.zeros((n, len(self.languages)))
        for i, column in enumerate(self.table):
            mask = np.full(len(hashes), 255, np.uint8)
            for at in self._places(hashes):
                mask &= column[at]
            by_mask = np.bincount(owner.astype(np.int64) * 256 + mask, minlength=n * 256).reshape(n, 256)
            own = slice(8 * i, min(8 * i + 8, len(self.languages)))
            found[:, own] = (by_mask @ _BITS_OF)[:, : own.stop - own.start]
        return np.bincount(owner, minlength=n).astype(np.float64), found


def _count(batches):
    """Counts of n-grams by language; those of a task are added up, TALLY at a time, so the map side passes an n-gram on once or seldom."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    runs: dict[str, list] = {}

    def merge() -> int:
        for name, run in runs.items():
            own, at = np.unique(np.concatenate([r[0] for r in run]), return_inverse=True)
            n = np.zeros(len(own), np.int64)
            np.add.at(n, at, np.concatenate([r[1] for r in run]))
            runs[name] = [(own, n)]
        return sum(len(run[0][0]) for run in runs.values())

    def passed():
        for name, [(own, n)] in runs.items():
            yield batch_of(schema, pa.repeat(name, len(own)), own.view(np.int64), n)
        runs.clear()

    held = 0
    for batch in batches:
        data, offsets = string_buffers(batch.column("text"))
        names = batch.column("lang").to_pylist()
        for a, b in byte_slices(offsets, SLICE):
            codes = {name: i for i, name in enumerate(dict.fromkeys(names[a:b]))}
            language = np.array([codes[x] for x in names[a:b]], np.int32)
            for hashes, owner, _ in parts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                for name, code in codes.items():
                    own, n = np.unique(hashes[language[owner] == code], return_counts=True)
                    if len(own):
                        runs.setdefault(name, []).append((own, n))
                        held += len(own) + 16  # an array counts too
                if held > TALLY:
                    held = merge()
                    if held > TALLY // 2:
                        yield from passed()
                        held = 0
    merge()
    yield from passed()


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Filter:
    """The filter learnt from labelled(doc_id, text, lang); rows with a null lang are left out.

    Repeated rows of one id and text count once, so that no hot row or id fills the sample.
    """
    spark = labelled.sparkSession
    labelled = labelled.where(F.col("lang").isNotNull()).select(F.xxhash64("doc_id", "text", F.lit(2)).alias("key"), F.col("lang").cast("string").alias("lang"), text_of())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}  # a row for each language
    if not counts:
        return Filter([], np.zeros((1, 8), np.uint8))
    languages = sorted(counts)
    # an Arrow table, because a list of rows would start a second kind of Python worker on every executor
    known = spark.createDataFrame(pa.table({"lang": languages, "code": pa.array(range(len(languages)), pa.int32()), "share": [min(1.0, fit_rows / max(counts[lang], 1)) for lang in languages]}))
    chosen = labelled.join(F.broadcast(known), "lang").where(F.pmod("key", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    chosen = chosen.groupBy("lang", "key", "code").agg(F.first("text").alias("text"))
    by_gram = chosen.select(F.col("code").cast("string").alias("lang"), "text").mapInArrow(_count, "lang string, gram long, n long").groupBy(F.col("lang").cast("int").alias("code"), "gram").agg(F.sum("n").alias("n"))
    rated = by_gram.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("code"))).withColumn("most", F.max("rate").over(Window.partitionBy("gram")))
    kept = Workspace(spark).save(rated.where(F.col("rate") >= SHARE * F.col("most")).select("code", "gram"), "grams")
    most = kept.groupBy("code").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    size = places_for(len(languages), most)
    place = F.explode(F.array(*[F.shiftrightunsigned("gram", 20 * i).bitwiseAND(F.lit(size - 1)).cast("int") for i in range(HASHES)]))
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.col("code") % 8 + 1)
    set_bits = kept.select(F.floor(F.col("code") / 8).cast("int").alias("slice"), bit.alias("bit"), place.alias("place")).groupBy("slice", "place").agg(F.bit_or("bit").cast("short").alias("mask"))
    found = set_bits.toArrow()  # at most a row for each byte of the table
    table = np.zeros((-(-len(languages) // 8), size), np.uint8)
    table[found["slice"].to_numpy(), found["place"].to_numpy()] = found["mask"].to_numpy()
    return Filter(languages, table)


def _predict(shared, n_carried: int, schema: pa.Schema):
    def run(batches):
        model = shared.value
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for a, b in byte_slices(offsets, SLICE):
                names, scores, covers = [UNKNOWN] * (b - a), np.zeros(b - a), np.zeros(b - a)
                if model.languages:
                    letters, total, found = np.zeros(b - a, np.int64), np.zeros(b - a), np.zeros((b - a, len(model.languages)))
                    for hashes, owner, n in parts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                        for sum_, more in zip((letters, total, found), (n, *model.hits(hashes, owner, b - a))):
                            sum_ += more
                    share = np.clip((found / np.maximum(total, 1)[:, None] - model.chance) / np.maximum(1 - model.chance, 1e-9), 0, 1)
                    best, weight = share.argmax(1), share.sum(1)
                    covers = np.where(letters > 0, share.max(1), 0.0)
                    scores = np.where(letters > 0, np.where(weight > 0, share.max(1) / np.maximum(weight, 1e-12), 1 / len(model.languages)), 0.0)
                    names = [model.languages[i] if n else UNKNOWN for i, n in zip(best.tolist(), letters.tolist())]
                columns = [batch.column(f"c{i}").slice(a, b - a) for i in range(n_carried)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip([*columns, names, scores, covers], schema)], schema=schema)

    return run


def predict(docs: DataFrame, model: Filter, columns: list[str] | None = None) -> DataFrame:
    """docs with the columns named (all by default) and lang_pred, score, coverage after them.

    score is the best language's share of all languages' corrected hits, from 0 to 1;
    coverage is the corrected share of the text's n-grams that the best language contains.
    Ties go to the language that is first by name. A null text, one without letters, and any text
    where no language was learnt give `und` with score and coverage 0. A text with letters but
    without a hit gives the first language with score 1 / languages and coverage 0. Repeated
    rows are predicted each; a very long text like any other, from all its n-grams; an empty table
    gives no rows; columns may have any names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    columns = docs.columns if columns is None else columns
    out = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)] + ["lang_pred string", "score double", "coverage double"])
    schema = to_arrow_schema(spark.createDataFrame([], out).schema)
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], text_of())
    shared = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared, len(columns), schema), out).toDF(*columns, "lang_pred", "score", "coverage")
