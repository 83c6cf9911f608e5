"""URL filter: host and path rules, and a character language-model ratio for the rest.

Two variable-order Markov models, one of accepted and one of rejected URLs, give
every character a probability from its longest known context of at most ORDER
characters, smoothed by Witten-Bell interpolation down to a uniform distribution. A
context of two characters or more is known if it was seen twice at least.
A URL's score is the difference of its log-likelihoods divided by its length; the
threshold is calibrated on examples that the models have not seen.

The examples are the distinct URLs that the rules decide, all of them and whole: those whose
crc32 mod 4 is not 0 are learnt, the others calibrate the threshold. The models are tables of
Spark, not of the driver: a row for each gram of six characters with its counts on either side,
from which those of the shorter grams and of the contexts are summed (`values_of`). No gram is
hashed or left out, and only the threshold and the counts of ranges of scores come to the
driver. URLs are scored in blocks of BLOCK characters: a block's distinct grams are joined with
their values and grouped back, so a gram that every URL has is joined once a block. A URL of over
SPAN characters is cut into pieces that overlap by a context.

Where fit_rows is given, and only then, the models are held in memory instead (`Ratio`): of the
fit_rows distinct URLs of each verdict with the least seeded hash, of those of over WINDOW
characters a window that counts as often as it fits into the URL, within MODEL_BYTES.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import Workspace, batch_of, partitions, small_batches
from strandlake.llm.wordhash import mix

ORDER = 5
#: Characters of a piece of a long URL, and of the pieces that are scored together.
SPAN, BLOCK = 1 << 16, 1 << 20
#: With fit_rows: characters of a long URL that are learnt.
WINDOW = 128
#: With fit_rows: most bytes of both models; over that, the contexts seen least often are left out.
MODEL_BYTES = 64 << 20
UNIFORM = 1 / 1114112
_ODD = np.uint64(0x9E3779B97F4A7C15)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the rules in use.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null. A rule fits its host and all hosts below it."""
    found = F.lit(None)
    for verdict, own, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(own + start).alias("rule"))).otherwise(found)
    return found


def lines(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each after `order` marks of a start and with one of an end; number of the text of each place that is predicted, else -1)."""
    joined = "".join("\x02" * order + t + "\x03" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) + 1 + order for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    for j in range(order):
        owner[first + j] = -1
    return points, owner


def contexts(points: np.ndarray, at: np.ndarray, order: int):
    """For each length from 0 to order: hashes of the contexts before the places, and of contexts and characters."""
    key = np.zeros(len(at), np.uint64)
    for k in range(order + 1):
        if k:
            key = mix(key + _ODD * points[at - k] + np.uint64(k))
        yield key, mix(key ^ mix(points[at] + _ODD))


class Markov:
    """A variable-order Markov model of strings: for each order sorted context and gram hashes with their counts."""

    def __init__(self, texts: list[str], order: int = ORDER, weights: list[int] | None = None, starts: list[int] | None = None):
        """weights: how often each text counts; starts: characters at each text's start that are context only."""
        self.order, self.tables = order, []
        points, owner = lines(texts, order)
        at = np.flatnonzero(owner >= 0)
        if starts is not None and len(at):
            first = np.concatenate([[0], np.flatnonzero(np.diff(owner[at])) + 1])
            nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            at = at[nth >= np.array(starts)[owner[at]]]
        weight = np.ones(len(at)) if weights is None else np.array(weights, np.float64)[owner[at]]
        for k, (context, gram) in enumerate(contexts(points, at, order)):
            grams, index, inverse = np.unique(gram, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weight, len(grams))
            names, of = np.unique(context[index], return_inverse=True)
            total, kinds = np.bincount(of, n, len(names)), np.bincount(of, minlength=len(names))
            known = total >= (2 if k >= 2 else 0)
            self.tables.append((names[known], total[known], kinds[known].astype(np.float64), grams[known[of]], n[known[of]]))

    def nbytes(self) -> int:
        return sum(x.nbytes for table in self.tables for x in table)

    def pruned(self, least: float) -> None:
        """Leaves out the longer contexts that were seen less than `least` times, with their grams' counts of under `least`."""
        for k, (names, total, kinds, grams, n) in enumerate(self.tables):
            if k:  # single characters are 36 MB at most
                often, much = total >= least, n >= least
                self.tables[k] = (names[often], total[often], kinds[often], grams[much], n[much])

    def log_probabilities(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        p = np.full(len(at), UNIFORM)
        for (names, total, kinds, grams, n), (context, gram) in zip(self.tables, contexts(points, at, self.order)):
            if not len(names):
                break
            i = np.minimum(np.searchsorted(names, context), len(names) - 1)
            known = names[i] == context  # a context is known only if the shorter ones are
            j = np.minimum(np.searchsorted(grams, gram), max(len(grams) - 1, 0))
            seen = np.where(grams[j] == gram, n[j], 0.0) if len(grams) else np.zeros(len(at))
            p = np.where(known, (seen + kinds[i] * p) / (total[i] + kinds[i]), p)
        return np.log(p)

    def probability(self, context: str, char: str) -> float:
        points = np.array([ord(c) for c in context[-self.order :].rjust(self.order, "\x02") + char], np.uint64)
        return float(np.exp(self.log_probabilities(points, np.array([self.order])))[0])


def cut_of(low: float, score: float) -> float:
    """A threshold between two scores. Any cuts alike: 0, which favours no model, if it lies there, else the middle. low: -inf below the least."""
    return 0.0 if low < 0 <= score else score if low == -math.inf else (score + low) / 2


class Ratio:
    """log P(url | accepted) - log P(url | rejected), per character, with its threshold.

    Examples are strings, or (window, weight, start) of long ones: how often the window counts, and
    how many characters at its start are context only.
    """

    def __init__(self, accepted: list, rejected: list, order: int = ORDER):
        held = lambda x: zlib.crc32(x[0].encode("utf-8", "surrogatepass")) % 4 == 0
        self.order, sides = order, [[(x, 1, 0) if isinstance(x, str) else tuple(x) for x in side] for side in (accepted, rejected)]
        self.models = []
        for side in sides:
            learnt = [x for x in side if not held(x)] or side
            self.models.append(Markov([x[0] for x in learnt], order, [x[1] for x in learnt], [x[2] for x in learnt]))
        least = 3
        while sum(m.nbytes() for m in self.models) > MODEL_BYTES:
            for m in self.models:
                m.pruned(least)
            least *= 2
        self.threshold = self._calibrated(*[self.scores([x[0] for x in side if held(x)]).tolist() for side in sides])

    def scores(self, urls: list[str]) -> np.ndarray:
        """Each distinct pair of a context and a character is looked up once for all urls."""
        points, owner = lines(urls, self.order)
        at = np.flatnonzero(owner >= 0)
        *_, (_, gram) = contexts(points, at, self.order)
        _, index, inverse = np.unique(gram, return_index=True, return_inverse=True)
        value = self.models[0].log_probabilities(points, at[index]) - self.models[1].log_probabilities(points, at[index])
        sums = np.bincount(owner[at], value[inverse], len(urls))
        return sums / np.array([len(u) + 1 for u in urls])

    def __call__(self, url: str) -> float:
        return float(self.scores([url])[0])

    @staticmethod
    def _calibrated(good: list[float], bad: list[float]) -> float:
        """The cut with the best balanced accuracy on held-out examples, the least of equals; 0 without both kinds."""
        if not good or not bad:
            return 0.0
        points = sorted([(s, 1) for s in good] + [(s, 0) for s in bad])
        best, cut, g, b = -1, 0.0, len(good), 0
        for i, (s, kind) in enumerate(points):
            if i == 0 or s != points[i - 1][0]:
                right = g * len(bad) + b * len(good)
                if right > best:
                    best, cut = right, cut_of(points[i - 1][0] if i else -math.inf, s)
            g, b = g - kind, b + 1 - kind
        return cut


def _score(shared):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("score", pa.float64()), ("threshold", pa.float64())])

    def run(batches):
        ratio = shared.value
        for batch in batches:
            urls = batch.column("url")
            texts, scores, at = [u or "" for u in urls.to_pylist()], [], 0
            while at < len(texts):  # about a million characters at a time
                upto, chars = at, 0
                while upto < len(texts) and chars < 1 << 20:
                    chars += len(texts[upto])
                    upto += 1
                scores.append(ratio.scores(texts[at:upto]))
                at = upto
            yield batch_of(schema, batch.column("page_id"), urls, np.concatenate([np.zeros(0), *scores]), [ratio.threshold] * len(texts))

    return run


def learnt_of(urls: DataFrame, fit_rows: int) -> list[tuple[str, int, int]]:
    """(window, weight, start) of the fit_rows distinct urls with the least seeded hash."""
    n = F.length("url")
    start = F.pmod(F.xxhash64("url", F.lit(7)), F.greatest(n - WINDOW + 1, F.lit(1))).cast("int")
    context = F.least(start, F.lit(ORDER))
    window = urls.select(F.xxhash64("url", F.lit(3)).alias("h"), F.substr("url", start - context + 1, context + WINDOW).alias("window"), F.ceil(F.greatest(n, F.lit(1)) / WINDOW).cast("int").alias("weight"), context.alias("start"))
    return [(r["window"], r["weight"], r["start"]) for r in window.orderBy("h", "window").limit(fit_rows).collect()]


def _cut(span: int, size: int):
    """(id, url) to (block, id, seq, text): pieces of at most span characters, the end's mark among them, after ORDER characters or marks of a start, in blocks of about size characters."""
    schema = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("seq", pa.int64()), ("text", pa.string())])

    def run(batches):
        block, rows, chars = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for i, url in zip(batch.column("id").to_pylist(), batch.column("url").to_pylist()):
                line = "\x02" * ORDER + url + "\x03"
                for seq, at in enumerate(range(0, len(line) - ORDER, span)):
                    rows.append((block, i, seq, line[at : at + span + ORDER]))
                    chars += len(rows[-1][3])
                    if chars >= size:
                        yield batch_of(schema, *map(list, zip(*rows)))
                        block, rows, chars = block + 1, [], 0
        if rows:
            yield batch_of(schema, *map(list, zip(*rows)))

    return run


def _gathered(batches):
    """Lists of (block, id, text) of one block and up to about BLOCK characters."""
    rows, chars = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "text"))):
            if rows and (row[0] != rows[0][0] or chars >= BLOCK):
                yield rows
                rows, chars = [], 0
            rows.append(row)
            chars += len(row[2])
    if rows:
        yield rows


def grams_of(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams of six characters that end at the predicted places of the pieces, as two integers of three code points each; numbers of their pieces."""
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in pieces], np.int64)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    at = np.flatnonzero(np.arange(len(points)) - (np.cumsum(sizes) - sizes)[owner] >= ORDER)
    three = lambda i: points[i - 2] << 42 | points[i - 1] << 21 | points[i]
    return three(at - 3), three(at), owner[at]


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of one of each kind of pairs, number of each pair's kind)."""
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


def _asked(batches):
    """The distinct grams of each block; of a block that is read in parts, of each part."""
    schema = pa.schema([("block", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])
    for rows in _gathered(batches):
        high, low, _ = grams_of([r[2] for r in rows])
        one, _ = distinct(high, low)
        yield batch_of(schema, np.full(len(one), rows[0][0]), high[one], low[one])


def _counted(batches):
    """Counts of grams in the pieces with id 1, accepted, and id 0, rejected."""
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("good", pa.int64()), ("bad", pa.int64())])
    for rows in _gathered(batches):
        high, low, owner = grams_of([r[2] for r in rows])
        one, kind = distinct(high, low)
        good = np.bincount(kind, np.array([r[1] for r in rows])[owner], len(one)).astype(np.int64)
        yield batch_of(schema, high[one], low[one], good, np.bincount(kind, minlength=len(one)) - good)


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of the values (high, low, value) of the grams of each piece (id, seq, text) of a block."""
    high, low, owner = grams_of(left["text"].to_pylist())
    known = right.num_rows
    one, kind = distinct(np.concatenate([right["high"].to_numpy(), high]), np.concatenate([right["low"].to_numpy(), low]))
    value = np.empty(len(one))
    value[kind[:known]] = right["value"].to_numpy()
    return pa.table({"id": left["id"], "seq": left["seq"], "total": np.bincount(owner, value[kind[known:]], left.num_rows)})


def _last(n: int) -> list[Column]:
    """high, low of the last n characters of grams."""
    return [F.col(c).bitwiseAND(F.lit((1 << 21 * m) - 1)).alias(c) for c, m in (("high", max(0, n - 3)), ("low", min(3, n)))]


def values_of(grams: DataFrame) -> DataFrame:
    """high, low, value of every row of grams(high, low, good, bad): the difference of the logarithms of its last character's probabilities.

    good, bad: how often the models learnt the gram, which may be never.
    """
    found = None
    for k in range(ORDER + 1):
        level = grams if k == ORDER else grams.groupBy(*_last(k + 1)).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = Window.partitionBy("high", F.shiftright("low", 21))
        for side in ("good", "bad"):
            level = level.withColumns({f"{side}_total": F.sum(side).over(context), f"{side}_kinds": F.sum((F.col(side) > 0).cast("long")).over(context)})
        if found is None:
            level = level.withColumns({"good_p": F.lit(UNIFORM), "bad_p": F.lit(UNIFORM)})
        else:
            high, low = _last(k)
            shorter = found.select(F.col("high").alias("shorter_high"), F.col("low").alias("shorter_low"), "good_p", "bad_p")
            level = level.withColumns({"shorter_high": high, "shorter_low": low}).join(shorter, ["shorter_high", "shorter_low"])
        p = [F.when(F.col(f"{s}_total") >= (2 if k >= 2 else 1), (F.col(s) + F.col(f"{s}_kinds") * F.col(f"{s}_p")) / (F.col(f"{s}_total") + F.col(f"{s}_kinds"))).otherwise(F.col(f"{s}_p")).alias(f"{s}_p") for s in ("good", "bad")]
        found = level.select("high", "low", *p)
    return found.select("high", "low", (F.log("good_p") - F.log("bad_p")).alias("value"))


def threshold_of(held: DataFrame, work: Workspace) -> float:
    """The cut with the best balanced accuracy on all of held(score, good 0 or 1), the least of equals; 0 without both kinds.

    Scores are sorted in ranges; counts and the greatest score of each range come to the driver.
    """
    points = held.groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    points = work.save(points.repartitionByRange(partitions(held.sparkSession), "score").withColumn("part", F.spark_partition_id()), "points")
    parts = points.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("last")).orderBy("part").collect()
    all_good, all_bad = (sum(r[side] for r in parts) for side in ("good", "bad"))
    if not all_good or not all_bad:
        return 0.0
    before, good, bad, last = [], 0, 0, -math.inf
    for r in parts:
        before.append((r["part"], good, bad, last))
        good, bad, last = good + r["good"], bad + r["bad"], r["last"]
    before = held.sparkSession.createDataFrame(before, "part int, good_before long, bad_before long, last_before double")
    lower = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda side: F.coalesce(F.sum(side).over(lower), F.lit(0)) + F.col(f"{side}_before")
    right = (F.lit(all_good) - below("good")).cast("decimal(38,0)") * F.lit(all_bad) + below("bad").cast("decimal(38,0)") * F.lit(all_good)
    found = points.join(F.broadcast(before), "part").select("score", F.coalesce(F.max("score").over(lower), "last_before").alias("low"), right.alias("right"))
    best = found.orderBy(F.desc("right"), "score").first()
    return cut_of(best["low"], best["score"])


def scored(rows: DataFrame, found: Column, work: Workspace, span: int = SPAN, block: int = BLOCK) -> tuple[DataFrame, float]:
    """(page_id, url, score of rows(page_id, url), which has no null url; the threshold). found: struct with the verdict that the rules give an url."""
    spark, held_out = rows.sparkSession, F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(4)) == 0
    tables = []

    def save(df: DataFrame, name: str) -> DataFrame:
        df = work.save(df, name)
        tables.append(work.last)
        return df

    rows = save(rows.withColumn("id", F.monotonically_increasing_id()), "rows")
    pieces = save(rows.select("id", "url").mapInArrow(_cut(span, block), "block long, id long, seq long, text string"), "pieces")
    known = rows.select("url", found["verdict"].alias("verdict"), held_out.alias("held_out")).where(F.col("verdict").isNotNull())
    some = [r["verdict"] for r in known.where(~F.col("held_out")).select("verdict").distinct().collect()]  # a side without others learns those held out
    learnt = known.where(~F.col("held_out") | ~F.col("verdict").isin(some)).select((F.col("verdict") == "allow").cast("long").alias("id"), "url").distinct()
    learnt = learnt.mapInArrow(_cut(span, block), "block long, id long, seq long, text string").mapInArrow(_counted, "high long, low long, good long, bad long")
    asked = pieces.mapInArrow(_asked, "block long, high long, low long")
    nothing = F.lit(0).cast("long")
    grams = asked.select("high", "low", nothing.alias("good"), nothing.alias("bad")).union(learnt).groupBy("high", "low").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    values = values_of(save(grams, "grams"))
    valued = asked.join(values, ["high", "low"]).groupBy("block")
    sums = pieces.select("block", "id", "seq", "text").groupBy("block").cogroup(valued).applyInArrow(_summed, "id long, seq long, total double")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "total"))), lambda x: x["total"])
    sums = sums.groupBy("id").agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x).alias("total"))
    out = work.save(rows.join(sums, "id").select("page_id", "url", (F.col("total") / (F.length("url") + 1)).alias("score")), "scored")
    held = out.where(held_out).select("url", (found["verdict"] == "allow").cast("long").alias("good"), "score").where(F.col("good").isNotNull()).distinct()
    threshold = threshold_of(held, work)
    tables.append(work.last)
    for path in tables:
        work._delete(path)
    return out, threshold


def judged(pages: DataFrame, rules=RULES, fit_rows: int | None = None, work: Workspace | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold for every row of pages(page_id, url).

    rule: host and path of the longest rule that fits, else null. verdict: allow or block,
    the rule's, or else by the score: allow at the threshold or above. fit_rows: most
    distinct urls of a verdict that are learnt, with the other bounds of a model in memory; all, whole, if None.

    A null url, or one without `://`, has an empty host and path, fits no rule, and is scored
    (null as the empty string). A very long url is learnt and scored whole. Repeated rows are judged each, and learnt once.
    Where the rules give no examples the models are uniform and the threshold is 0. An empty table gives no rows;
    other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    found = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    if fit_rows is None:
        done, threshold = scored(rows.withColumn("url", F.coalesce("url", F.lit(""))), found, work or Workspace(spark))
        done = done.withColumn("threshold", F.lit(threshold))
    else:
        known = rows.select("url", found["verdict"].alias("verdict")).where(F.col("verdict").isNotNull())
        examples = [learnt_of(known.where(F.col("verdict") == v).select("url").distinct(), fit_rows) for v in ("allow", "block")]
        shared = spark.sparkContext.broadcast(Ratio(*examples))
        done = rows.mapInArrow(_score(shared), "page_id long, url string, score double, threshold double")
    done = done.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "score", "threshold")
    found = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return done.select("page_id", "host", "path", found["rule"].alias("rule"), F.coalesce(found["verdict"], own).alias("verdict"), "score", "threshold")
