"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of each source are ranked in a seeded random order; the fractional rank
(2 * rank + 1) / (2 * rows of the source) puts all sources on one scale from 0 to
1, and cutting the rows in that order into equal runs gives every shard each
source's share, to within a row or two.

Neither ranking gathers a source or sorts the whole table in one task. The seeded
hash is uniform, so its first digits cut every source into even buckets; a row's
rank is the number of rows in the buckets before plus its number in the bucket.
The global position is found the same way from buckets of the fractional rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import Workspace

#: Rows that one bucket holds on average.
BUCKET_ROWS = 20_000
SEED = "strandlake-6"


def _before(*order):
    return Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def interleave(docs: DataFrame, shards: int = 16, seed: str = SEED, bucket_rows: int = BUCKET_ROWS, work: Workspace | None = None) -> DataFrame:
    """doc_id, source, size, text_crc32, position, shard, slot for every row of docs(doc_id, text, source).

    size: UTF-8 bytes of the text plus 1 (null: 1); text_crc32: its unsigned crc32 (null:
    of the empty text). Shards differ by one row at most; slot counts from 0 in each.
    A null source is a source of its own, and a null id hashes like the empty string. Ties of the
    seeded hash of id, size and crc32 are ordered by id, size and crc32; full repeats are interchangeable.
    A very long text counts with its whole size. An empty table gives no rows; with fewer rows than shards some shards stay empty. Other columns are ignored.
    """
    work = work or Workspace(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # size and crc32 keep rows of one id, or without id, apart
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32").cast("binary"))
    rows = work.save(rows.withColumn("key", key), "rows")
    n = rows.count()
    buckets = max(1, min(65536, -(-n // bucket_rows)))
    first = F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * buckets / F.lit(65536)).cast("int")
    rows = rows.withColumn("bucket", first)

    by_bucket = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("source").orderBy("bucket")
    by_bucket = by_bucket.select(F.col("source").alias("of"), F.col("bucket").alias("in"), (F.sum("n").over(run) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy("source")).alias("total"))
    nth = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "text_crc32"))
    ranked = rows.withColumn("nth", nth).join(by_bucket, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
    rank = F.col("base") + F.col("nth") - 1
    ranked = work.save(ranked.select("doc_id", "source", "size", "text_crc32", "key", ((2 * rank + 1).cast("double") / (2 * F.col("total")).cast("double")).alias("fraction")), "ranked")

    ranked = ranked.withColumn("bucket", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("int"))
    # at most one row for each bucket, that is rows / bucket_rows
    bases = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(_before("bucket")), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("fraction", "key", F.col("source").asc_nulls_first(), "doc_id", "size", "text_crc32"))
    placed = ranked.withColumn("nth", nth).join(bases, "bucket").withColumn("position", F.col("base") + F.col("nth") - 1)
    shard = F.expr(f"position * {shards} div {n or 1}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - start).select("doc_id", "source", "size", "text_crc32", F.col("position").cast("long").alias("position"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
