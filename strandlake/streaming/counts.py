"""Counting k-mers of a stream of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import seqops


def running_counts(stream: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """kmer, count over all rows of a streaming DataFrame so far; write it in update or complete mode.

    k-mers have no event time, so there is no watermark and the state grows with the number
    of distinct k-mers; use the RocksDB state store for large ones.
    """
    rows = seqops.kmers(seqops.runs(stream, seq), k)
    return rows.groupBy(seqops.canonical("kmer").alias("kmer")).agg(F.count(F.lit(1)).alias("count"))
