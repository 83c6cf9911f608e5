"""Minimizers, super-k-mers, minimizer partitions and what can be said of them.

A k-mer's minimizer is the least canonical ntHash of its m-mers. Hashes are unsigned;
in columns they are longs with the same bits (`minimizer`), so compare them for
equality only, or their text form from hash_hex.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import bases, seqops
from strandlake.plans import vector
from strandlake.plans.vector import slices


def hash_hex(value) -> Column:
    """16 hex digits, lower case."""
    return F.lower(F.lpad(F.hex(seqops.col(value)), 16, "0"))


def longest(k: int, m: int) -> int:
    """Most bases of a super-k-mer: what its length field holds."""
    return 255 if 2 * k - m <= 255 else 65535


#: Bytes of sequence for each minimizer partition, which one task counts.
PARTITION_BYTES = 64 << 20
#: Bytes of sequence for each bin of a partition, whose distinct k-mers a task holds at a time; the least number of bins, and those of a partition where the input's size is not known.
BIN_BYTES, LEAST_BINS, BINS = 1 << 20, 512, 64


def input_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate; None where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 50 else None


def default_partitions(df: DataFrame, size: int | None = None) -> int:
    """A power of two: the session's shuffle partitions, or more if the input's size (estimated, if not given) asks for it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n = max(n, -(-(size or input_bytes(df) or 0) // PARTITION_BYTES))
    return 1 << max(0, (n - 1).bit_length())


def partition_of(minimizer, n: int) -> Column:
    """minimizer & (n - 1), n a power of two."""
    if n < 1 or n & (n - 1):
        raise ValueError("the number of partitions must be a power of two")
    return seqops.col(minimizer).bitwiseAND(F.lit(n - 1)).cast("int")


def mmer_hashes(df: DataFrame, m: int, *keep: str, seq: str = "seq") -> DataFrame:
    """keep..., pos (in the row's text), hash: canonical ntHash of all windows of m bases."""
    def values(codes):
        return bases.nthash(codes, m)

    return _by_window(df, m, values, "hash", keep, seq)


def minimizers(df: DataFrame, k: int, m: int, *keep: str, seq: str = "seq") -> DataFrame:
    """keep..., pos, minimizer: of every window of k bases."""
    seqops.check_km(k, m)

    def values(codes):
        return bases.sliding_min(bases.nthash(codes, m), k - m + 1)

    return _by_window(df, k, values, "minimizer", keep, seq)


def vertices(df: DataFrame, k: int, m: int, *keep: str, seq: str = "seq") -> DataFrame:
    """keep..., pos, kmer, canonical, is_forward, minimizer, min_pos: every window of k bases with all that is known of it.

    min_pos is the place in the window, from 0, of the first m-mer that has the minimizer's hash.
    """
    seqops.check_km(k, m)
    names = [*keep, "pos", "kmer", "minimizer", "min_pos"]
    out = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["pos long", "kmer string", "minimizer long", "min_pos int"])

    def run(batches):
        for batch in batches:
            data, offsets = bases.buffers(batch.column(len(keep)))
            for codes, ends, base in slices(data, offsets, k, 1 << 16):
                at = bases.valid_windows(codes, ends, k)
                if len(at):
                    hashes = bases.nthash(codes, m)
                    least = bases.sliding_min(hashes, k - m + 1)[at]
                    row = np.searchsorted(offsets, at + base, "right") - 1
                    columns = [batch.column(i).take(pa.array(row)) for i in range(len(keep))]
                    columns += [pa.array(at + base - offsets[row]), bases.string_array(bases.LETTER[codes[at[:, None] + np.arange(k)]]), pa.array(least.view(np.int64)), pa.array(bases.first_of(hashes, least, at, k - m + 1))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    found = df.select(*keep, seq).mapInArrow(run, out)
    return found.select(*keep, "pos", "kmer", seqops.canonical("kmer").alias("canonical"), seqops.in_canonical_form("kmer").alias("is_forward"), "minimizer", "min_pos")


def _by_window(df, k, values, name, keep, seq):
    out = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["pos long", f"{name} long"])

    def run(batches):
        for batch in batches:
            data, offsets = bases.buffers(batch.column(len(keep)))
            for codes, ends, base in slices(data, offsets, k):
                at = bases.valid_windows(codes, ends, k)
                if len(at):
                    row = np.searchsorted(offsets, at + base, "right") - 1
                    columns = [batch.column(i).take(pa.array(row)) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(at + base - offsets[row]), pa.array(values(codes)[at].view(np.int64))], names=[*keep, "pos", name])

    return df.select(*keep, seq).mapInArrow(run, out)


def _pieces(data, offsets, k, m, size=vector.SLICE):
    """(first base, bases, minimizer) of the super-k-mers of a batch, those of a slice at a time.

    A stretch of consecutive windows with one minimizer is cut where it is longer than the length field holds. Its last
    piece waits for the next slice, where the stretch may go on.
    """
    room = longest(k, m) - k + 1
    start, count, h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)  # the piece that waits
    for codes, ends, base in slices(data, offsets, k, size):
        at = bases.valid_windows(codes, ends, k)
        if not len(at):
            continue
        least = bases.sliding_min(bases.nthash(codes, m), k - m + 1)[at]
        at = at + base
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)]))  # windows of two rows are k apart
        n = np.diff(np.append(first, len(at)))
        if len(start) and start[0] + count[0] == at[0] and h[0] == least[0]:
            n[0] += count[0]
            start, h = np.concatenate([start, at[first[1:]]]), least[first]
        else:
            start, n, h = np.concatenate([start, at[first]]), np.concatenate([count, n]), np.concatenate([h, least[first]])
        pieces = -(-n // room)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, count, h = np.repeat(start, pieces) + nth * room, np.minimum(np.repeat(n, pieces) - nth * room, room), np.repeat(h, pieces)
        if len(start) > 1:
            yield start[:-1], count[:-1] + k - 1, h[:-1]
        start, count, h = start[-1:], count[-1:], h[-1:]
    if len(start):
        yield start, count + k - 1, h


def superkmers(df: DataFrame, k: int, m: int, *keep: str, seq: str = "seq", packed: bool = False, positions: bool = False) -> DataFrame:
    """keep..., pos, n_bases, minimizer (with positions also min_pos, with packed also sk): the super-k-mers of each row's runs.

    A stretch of consecutive k-mers with one minimizer is one super-k-mer, or several that
    overlap by k - 1 bases where it is longer than the length field holds. min_pos is where in it
    the first m-mer with the minimizer's hash starts.
    """
    seqops.check_km(k, m)
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["pos long", "n_bases int", "minimizer long"] + ["min_pos int"] * positions + ["sk binary"] * packed
    names = [*keep, "pos", "n_bases", "minimizer"] + ["min_pos"] * positions + ["sk"] * packed

    def run(batches):
        for batch in batches:
            data, offsets = bases.buffers(batch.column(len(keep)))
            for at, n, h in _pieces(data, offsets, k, m):
                row = np.searchsorted(offsets, at, "right") - 1
                columns = [batch.column(i).take(pa.array(row)) for i in range(len(keep))]
                columns += [pa.array(at - offsets[row]), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64))]
                codes = bases.CODE[data[at[0] : at[-1] + n[-1]]]
                if positions:
                    columns.append(pa.array(bases.first_of(bases.nthash(codes, m), h, at - at[0], k - m + 1)))
                if packed:
                    columns.append(bases.binary_array(*bases.pack_all(codes, at - at[0], n)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(*keep, seq).mapInArrow(run, ", ".join(fields))


def first_kmer(sk, k: int) -> Column:
    """The first k-mer of a packed super-k-mer, as text."""
    pairs = F.array(*[F.lit(a + b) for a in "ACGT" for b in "ACGT"])
    digits = F.split(F.substring(F.hex(seqops.col(sk)), 1, -(-k // 2)), "")
    return F.left(F.array_join(F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.element_at(pairs, F.instr(F.lit("0123456789ABCDEF"), d))), ""), F.lit(k))


def count_by_partition(df: DataFrame, k: int, m: int, seq: str = "seq", partitions: int | None = None, min_count: int = 1, max_count: int | None = None, size: int | None = None) -> DataFrame:
    """kmer, count by one exchange, of packed super-k-mers by minimizer partition.

    A k-mer has one minimizer, so partitions share no k-mers. Bits of the minimizer cut a partition into bins; its task
    sorts them (Spark's sort, which spills) and holds the distinct k-mers of one bin at a time. The super-k-mers that a
    slice of a batch has for a bin travel as one row: lengths, and two bits a base. size is that of the input in bytes, where it is known.

    K-mers leave in the order in which they first occur in their bin, so that neighbours overlap and the rows compress well.
    """
    seqops.check_km(k, m)
    size = size or input_bytes(df)
    parts = partitions or default_partitions(df, size)
    partition_of(F.lit(0), parts)  # a power of two
    tasks = min(parts, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), df.sparkSession.sparkContext.defaultParallelism, (size or 0) // PARTITION_BYTES))
    bins = parts * BINS if size is None else max(parts, LEAST_BINS, 1 << (size // BIN_BYTES).bit_length())

    length = np.uint8 if longest(k, m) < 256 else np.dtype("<u2")

    def bundled(batches):
        for batch in batches:
            data, offsets = bases.buffers(batch.column(0))
            for at, n, h in _pieces(data, offsets, k, m, 2 * vector.SLICE):
                codes = bases.CODE[data[at[0] : at[-1] + n[-1]]]
                pid = (h & np.uint64(bins - 1)).astype(np.int32)
                order = np.argsort(pid, kind="stable")
                at, n, pid = at[order] - at[0], n[order], pid[order]
                packed, ends = bases.pack_all(codes, at, n)
                first = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]]))
                last = np.append(first, len(pid))
                yield pa.RecordBatch.from_arrays([pa.array(pid[first]), bases.binary_array(n.astype(length).view(np.uint8), np.dtype(length).itemsize * last), bases.binary_array(packed, ends[last])], names=["pid", "lengths", "sk"])

    def spelled(tally):
        words, n = tally.counts()
        kept = np.flatnonzero((n >= min_count) & (n <= (2**62 if max_count is None else max_count)))
        for i in range(0, len(kept), 1 << 16):
            some = kept[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([bases.string_array(bases.letters(np.stack([w[some] for w in words], 1), k)), pa.array(n[some])], names=["kmer", "count"])

    def counted(batches):
        tally, bin_, held, sizes, windows = vector.Tally(k), None, [], [], 0

        def settle():
            nonlocal held, sizes, windows
            if held:
                tally.add_words(bases.packed_words(np.concatenate(held), np.concatenate(sizes), k))
            held, sizes, windows = [], [], 0

        for batch in batches:
            for pid, lengths, sk in zip(batch.column("pid").to_pylist(), batch.column("lengths"), batch.column("sk")):
                if pid != bin_:
                    settle()
                    yield from spelled(tally)
                    tally, bin_ = vector.Tally(k), pid
                sizes.append(np.frombuffer(lengths.as_buffer(), length).astype(np.int64))
                held.append(np.frombuffer(sk.as_buffer(), np.uint8))
                windows += int(sizes[-1].sum()) - (k - 1) * len(sizes[-1])
                if windows >= vector.SLICE:
                    settle()
        settle()
        yield from spelled(tally)

    rows = df.select(seq).mapInArrow(bundled, "pid int, lengths binary, sk binary")
    return rows.repartitionById(tasks, F.pmod("pid", F.lit(tasks))).sortWithinPartitions("pid").mapInArrow(counted, "kmer string, count long")


def run_stats(df: DataFrame, k: int, m: int, seq: str = "seq") -> DataFrame:
    """seqs, kmers, superkmers: one row, without counting k-mers (the partition-only mode)."""
    from strandlake.operators import count

    sk = superkmers(df, k, m, seq=seq).agg(F.count(F.lit(1)).alias("superkmers"))
    both = count.run_stats(df, k, seq).withColumn("_", F.lit(1)).join(sk.withColumn("_", F.lit(1)), "_")  # one row each
    return both.select("seqs", "kmers", "superkmers")


def coverage(df: DataFrame, k: int, m: int, seq: str = "seq") -> DataFrame:
    """minimizer, coverage: k-mer occurrences of each minimizer, summed by slices of a batch before the exchange."""
    seqops.check_km(k, m)

    def run(batches):
        for batch in batches:
            for _, n, h in _pieces(*bases.buffers(batch.column(0)), k, m):
                (h,), n = vector.gathered([h], n - (k - 1))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["minimizer", "n"])

    return df.select(seq).mapInArrow(run, "minimizer long, n long").groupBy("minimizer").agg(F.sum("n").alias("coverage"))


def coverage_histogram(covered: DataFrame) -> DataFrame:
    """coverage, n_minimizers, total_kmers, by coverage."""
    return covered.groupBy("coverage").agg(F.count(F.lit(1)).alias("n_minimizers"), F.sum("coverage").alias("total_kmers")).orderBy("coverage")


def coverage_summary(covered: DataFrame) -> DataFrame:
    return covered.agg(F.count(F.lit(1)).alias("n_minimizers"), F.coalesce(F.sum("coverage"), F.lit(0)).alias("total_kmers"), F.avg("coverage").alias("avg_coverage"), F.max("coverage").alias("max_coverage"))


def hot_bins(covered: DataFrame, n: int = 20) -> DataFrame:
    """bin, kmers: the n bins (top eight bits of the minimizer) with most k-mer occurrences."""
    return covered.groupBy(F.shiftrightunsigned("minimizer", 56).cast("int").alias("bin")).agg(F.sum("coverage").alias("kmers")).orderBy(F.desc("kmers"), "bin").limit(n)


def partition_table(df: DataFrame, k: int, m: int, n: int, seq: str = "seq", counted: DataFrame | None = None) -> DataFrame:
    """partition_id, n_inserted, n_unique: k-mer occurrences and distinct k-mers of each minimizer partition (of counted, if given)."""
    counted = count_kmers_by_minimizer(df, k, m, seq, counted)
    return counted.groupBy(partition_of("minimizer", n).alias("partition_id")).agg(F.sum("count").alias("n_inserted"), F.count(F.lit(1)).alias("n_unique"))


def count_kmers_by_minimizer(df: DataFrame, k: int, m: int, seq: str = "seq", counted: DataFrame | None = None) -> DataFrame:
    """kmer, minimizer, count: a k-mer's minimizer is a function of it, found from the counted k-mer."""
    if counted is None:
        from strandlake.operators import count

        counted = count.count_kmers(df.sparkSession, df, k, m, seq=seq)
    return minimizers(counted, k, m, "kmer", "count", seq="kmer").select("kmer", "minimizer", "count")


def partition_summary(table: DataFrame) -> DataFrame:
    return table.agg(*[f(c).cast("double").alias(f"{name}_{c}") for c in ("n_inserted", "n_unique") for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def largest_partitions(table: DataFrame, n: int = 10) -> DataFrame:
    return table.orderBy(F.desc("n_inserted"), "partition_id").limit(n)
