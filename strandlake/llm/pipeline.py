"""The corpus pipeline: five of the training-data operators, one after the other.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents, whatever their names: columns of
docs are carried by their place. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate as bench
from strandlake.llm import language, neardup, packing, quality
from strandlake.llm.common import Workspace, table

#: Least share of a text's n-grams that its language must contain.
COVERAGE = 0.3

#: A stage can't be expressed in SQL: two of them learn models.
ORACLE_SQL = None


def _carried(found: DataFrame, columns: list[str], condition) -> DataFrame:
    """The rows of found for which condition(of its columns after `columns`, by place) holds, with `columns` alone."""
    own = [f"c{i}" for i in range(len(columns))]
    more = [f"m{i}" for i in range(len(found.columns) - len(columns))]
    kept = found.toDF(*own, *more).where(condition(*[F.col(m) for m in more]))
    return kept.select(*[F.col(c).alias(name) for c, name in zip(own, columns)])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below its threshold.

    Null and empty texts have the score the model gives an empty text; long texts are scored whole.
    A score at the threshold stays. Rows that repeat an id are scored each by its own text.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _carried(quality.score(docs, model), docs.columns, lambda score: score >= quality.THRESHOLD)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those of which no learned language contains enough; none where none was learnt.

    So null and empty texts go; long texts are judged whole. Rows that repeat an id are judged each, and
    which of two equally likely languages is taken doesn't matter.
    """
    model = language.fit(docs)
    if not model.languages:
        return docs
    return _carried(language.predict(docs, model), docs.columns, lambda name, score, coverage: (name != language.UNKNOWN) & (coverage >= COVERAGE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five words, 0.8) one row: that with the least id.

    Rows are judged each by its own text, so different texts under one id all stay. Rows
    without an id come after those with one; of rows with the same least id, one stays. Texts
    without words, null ones too, are near nothing and all stay, but for repeats of one id and text.
    """
    work, names = Workspace(spark), docs.columns
    own = [f"c{i}" for i in range(len(names))]
    # written, so that a row's number is the same whenever it is read
    rows = work.save(docs.toDF(*own).withColumn("row", F.monotonically_increasing_id()), "rows")
    text = F.col(own[names.index("text")])
    found = neardup.near_duplicates(rows.select(F.col("row").alias("doc_id"), text.alias("text")), shingle=5, work=work)
    found = found.select(F.col("doc_id").alias("row"), "component_id", (F.col("n_shingles") == 0).alias("blank"))
    named = rows.select("row", F.col(own[names.index("doc_id")]).cast("long").alias("id"), F.xxhash64(text).alias("text")).join(found, "row")
    # a blank row is its own group, or with an id that of the id and text
    alone = F.col("blank") & F.col("id").isNotNull()
    group = [F.when(~alone, F.col("component_id")).alias("g"), F.when(alone, F.col("id")).alias("i"), F.when(alone, F.col("text")).alias("t")]
    kept = named.groupBy(*group).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text", "row"))["row"].alias("row"))
    return rows.join(kept.select("row"), "row", "left_semi").select(*[F.col(c).alias(name) for c, name in zip(own, names)])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents and cuts benchmark passages out of the others.

    Null and empty texts have no hits and stay; long ones are scanned whole; rows that repeat an id are judged each.
    """
    return bench.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into training sequences.

    A null or empty text is one piece of the end id; a long text fills sequences of its own; rows that
    repeat an id are packed each, and which of two pieces of one length comes first is decided by id and content.
    """
    return packing.pack(docs)


STAGES = [("quality", quality_filter), ("language", language_filter), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that all stages keep. A stage's tables go when its successor's input is written."""
    work, before = Workspace(spark), ""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with Workspace.scope():
            docs = work.save(stage(spark, docs, sf_dir), name, instead=before)
        before = work.last
    return docs
