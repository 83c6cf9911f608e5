"""What the training-data operators share: tables, shared storage, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to a Python worker, so that a batch stays small
#: also where a text has a hundred thousand characters.
ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text"):
    """The text column as a string, empty where null."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias("text")


def crc_of_id(name: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


class Workspace:
    """Tables of one run in the folder that all executors share.

    The folder is the session's spark.checkpoint.dir. Where that is unset a local
    session gets a temporary folder; on a cluster that is an error, because no
    machine-local folder could be read again after the loss of an executor.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="strandlake-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.path = f"{base.rstrip('/')}/strandlake-{uuid.uuid4().hex}"
        self.tables, self.last = 0, ""
        atexit.register(self.clear)
        for scope in Workspace._scopes:
            scope.append(self)

    _scopes: list[list["Workspace"]] = []

    @classmethod
    @contextlib.contextmanager
    def scope(cls):
        """Clears at its end the workspaces that were opened in it: what was made of their tables must be saved elsewhere."""
        cls._scopes.append(own := [])
        try:
            yield
        finally:
            cls._scopes.remove(own)
            for work in own:
                work.clear()

    def save(self, df: DataFrame, name: str, instead: str = "") -> DataFrame:
        """Write df as Parquet and read it again: its lineage ends here. instead: a table's path that is deleted then."""
        self.tables += 1
        self.last = f"{self.path}/{self.tables:03d}-{name}"
        df.write.mode("overwrite").parquet(self.last)
        if instead:
            self._delete(instead)
        return self.spark.read.schema(df.schema).parquet(self.last)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # the session has ended: its owner cleans the folder
            pass
        atexit.unregister(self.clear)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, in this session; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, f"{ARROW_BYTES}b"))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
