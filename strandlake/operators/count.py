"""Counting canonical k-mers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import bases, seqops
from strandlake.plans import vector

PLANS = ("vector", "sql", "minimizer", "auto")
#: Up to so many bases a batch holds most k-mers more than once, and counting it first leaves little to exchange.
SHORT = 11


def sequences(spark: SparkSession, source, seq: str = "seq") -> DataFrame:
    """A DataFrame with the sequences: source itself, or the FASTA and FASTQ files named (also @list files)."""
    if isinstance(source, DataFrame):
        return source
    from strandlake.sources import fastx

    return fastx.read(spark, source, columns=("seq",))


def _few_tasks(spark: SparkSession, source) -> bool:
    from strandlake.sources import fastx

    return len(fastx.ranges(fastx.expand(source))) < spark.sparkContext.defaultParallelism


#: Bytes of sequence in a byte of a gzip file.
UNPACKED = 4


def _bytes(source) -> int:
    """Of the sequences of files, about."""
    from strandlake.sources import fastx

    return sum((UNPACKED if fastx.is_gzip(file) else 1) * (fastx.size_of(file) or 0) for file in fastx.expand(source))


def count_kmers(spark: SparkSession, source, k: int = 31, m: int | None = None, min_count: int = 1, max_count: int | None = None, plan: str = "auto", seq: str = "seq", partitions: int | None = None) -> DataFrame:
    """kmer, count: the canonical k-mers of all sequences with min_count <= count <= max_count.

    Upper-case k-mers, unique, in no order. Counts are over all files or rows together. An empty
    path list is a ValueError, and so are k outside 2..256, m outside 1..32, m >= k; m is 21, or
    k - 1 if that is less, where none is given. min_count 0 is like 1; min_count over max_count gives no rows. The result is the same for every plan and every m:
    `vector` counts integer keys in each batch and exchanges those, `sql` uses built-in expressions only,
    `minimizer` exchanges packed super-k-mers by partition and counts each partition on its own; `auto` is
    `vector` up to SHORT bases, else `minimizer`.
    """
    seqops.check_k(k)
    if plan not in PLANS:
        raise ValueError(f"plan must be one of {PLANS}")
    m = min(21, k - 1) if m is None else m
    seqops.check_km(k, m)
    df = sequences(spark, source)
    if not isinstance(source, DataFrame) and _few_tasks(spark, source):
        df = spread(df, k)
    if plan == "sql":
        rows = seqops.kmers(seqops.runs(df, seq), k)
        counts = rows.groupBy(seqops.canonical("kmer").alias("kmer")).agg(F.count(F.lit(1)).alias("count"))
        return in_range(counts, min_count, max_count)
    if plan == "minimizer" or plan == "auto" and k > SHORT:
        from strandlake.operators import minimizers

        return minimizers.count_by_partition(df, k, m, seq, partitions, min_count, max_count, None if isinstance(source, DataFrame) else _bytes(source))
    return vector.decoded(in_range(vector.count_keys(df, seq, k), min_count, max_count), k)


#: Bases of a part of a long sequence.
PART = 1 << 20


def spread(df: DataFrame, k: int, seq: str = "seq", part: int = PART) -> DataFrame:
    """seq: the sequences dealt to all cores, long ones in parts that overlap by k - 1 bases, so that each k-mer is in one part.

    For files that one task reads (gzip), or of few long records: what follows is not bound to that task.
    """

    def cut(batches):
        for batch in batches:
            data, offsets = bases.buffers(batch.column(0))
            lengths = np.diff(offsets)
            n = np.maximum(1, -(-(lengths - k + 1) // part))
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(offsets[:-1], n) + nth * part
            end = np.minimum(start + part + k - 1, np.repeat(offsets[1:], n))
            for a in range(0, len(start), 64):
                yield pa.RecordBatch.from_arrays([pa.array([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(start[a : a + 64].tolist(), end[a : a + 64].tolist())], pa.string())], names=["seq"])

    return df.select(F.col(seq).alias("seq")).mapInArrow(cut, "seq string").repartition(df.sparkSession.sparkContext.defaultParallelism)


def in_range(counts: DataFrame, min_count: int = 1, max_count: int | None = None) -> DataFrame:
    kept = counts.where(F.col("count") >= min_count)
    return kept if max_count is None else kept.where(F.col("count") <= max_count)


def run_stats(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """seqs, kmers: runs of bases of any length, and windows of k bases in them."""
    lengths = F.transform(seqops.acgt_runs(seq), lambda r: F.length(r))
    rows = df.select(F.size(lengths).alias("r"), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + F.greatest(n - k + 1, F.lit(0))).alias("w"))
    return rows.agg(F.coalesce(F.sum(F.greatest("r", F.lit(0))), F.lit(0)).cast("long").alias("seqs"), F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("kmers"))


def collect_dict(counts: DataFrame) -> dict[str, int]:
    """All counts on the driver: for results known to be small."""
    return {r["kmer"]: r["count"] for r in counts.toLocalIterator()}


def packed(counts: DataFrame, k: int) -> DataFrame:
    """kmer_packed, count: two bits a base, the first base in the highest bits of the first byte."""
    return counts.select(seqops.pack("kmer", k).alias("kmer_packed"), "count")


def for_each(counts: DataFrame, callback, binary: int | None = None) -> None:
    """Call callback(kmer, count) on the executors for every row; with binary=k on packed k-mers."""
    rows = packed(counts, binary) if binary else counts
    rows.foreachPartition(lambda part: [callback(r[0], r[1]) for r in part] and None)


def lookup(counts: DataFrame, wanted: DataFrame, kmer: str = "kmer") -> DataFrame:
    """wanted's k-mers (either strand) with their counts, 0 where absent."""
    asked = wanted.select(F.col(kmer).alias("query"), seqops.canonical(F.upper(kmer)).alias("kmer"))
    return asked.join(counts, "kmer", "left").select("query", "kmer", F.coalesce("count", F.lit(0)).alias("count"))


def reduce_by_kmer(rows: DataFrame, *aggregates, kmer: str = "kmer") -> DataFrame:
    """Any aggregates by canonical k-mer: the keyed reduction that counting is one case of."""
    return rows.groupBy(seqops.canonical(kmer).alias("kmer")).agg(*aggregates)


def distinct_kmers(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    return count_kmers(df.sparkSession, df, k, seq=seq).select("kmer")
