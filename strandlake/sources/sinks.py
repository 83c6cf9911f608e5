"""Writing counts: TSV, KFF, Parquet. Rows are written by the tasks; the driver only joins their parts, byte by byte, where one file is asked for."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strandlake.functions import bases
from strandlake.sources.fastx import SPLIT, _file, open_file

_ENCODING = 0b00011011  # A 0, C 1, G 2, T 3


def write_counts(counts: DataFrame, path: str, k: int | None = None) -> None:
    """Write kmer, count: one KFF file to a name in .kff, one TSV file to .tsv or .txt, Parquet to .parquet, else a directory of TSV files."""
    if path.endswith(".kff"):
        write_kff(counts, path, k)
    elif path.endswith((".tsv", ".txt")):
        write_tsv_file(counts, path)
    elif path.endswith(".parquet"):
        counts.write.mode("overwrite").parquet(path)
    else:
        counts.select("kmer", "count").write.mode("overwrite").option("sep", "\t").csv(path)


def write_tsv_file(counts: DataFrame, path: str) -> None:
    """One file of `kmer TAB count` lines without a header: the tasks' parts, joined in the JVM. Paths are Hadoop's, as of all Spark writers."""
    spark = counts.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    counts.select("kmer", "count").write.option("sep", "\t").csv(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    try:
        out = system.create(target, True)
        for name in sorted(x.getPath().toString() for x in system.listStatus(hadoop.fs.Path(parts)) if x.getPath().getName().startswith("part-")):
            part = system.open(hadoop.fs.Path(name))
            hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
        out.close()
    finally:
        system.delete(hadoop.fs.Path(parts), True)


def packed_rows(kmers, align: str = "left") -> np.ndarray:
    """Two bits a base, four bases a byte, as rows, of an Arrow array of equally long k-mers; a part byte has its padding last (left) or first (right)."""
    data, offsets = bases.buffers(kmers)
    n, k = len(kmers), int(offsets[1])
    width = -(-k // 4) * 4
    full = np.zeros((n, width), np.uint8)
    full[:, (0 if align == "left" else width - k) : (k if align == "left" else width)] = bases.CODE[data].reshape(n, k)
    full = full.reshape(n, -1, 4)
    return full[:, :, 0] << 6 | full[:, :, 1] << 4 | full[:, :, 2] << 2 | full[:, :, 3]


def kff_head(k: int) -> bytes:
    """Header and variables: unique canonical k-mers, one a block, counts of four bytes; then the mark of a raw section."""
    variables = b"".join(name + b"\0" + struct.pack(">Q", value) for name, value in ((b"k", k), (b"max", 1), (b"data_size", 4)))
    return b"KFF" + bytes([1, 0, _ENCODING, 1, 1]) + struct.pack(">I", 0) + b"v" + struct.pack(">Q", 3) + variables + b"r"


def _create(path: str):
    system, name = _file(path)
    if system is None:
        os.makedirs(os.path.dirname(name) or ".", exist_ok=True)
        return open(name, "wb")
    system.create_dir(os.path.dirname(name), recursive=True)
    return system.open_output_stream(name)


def _remove(path: str) -> None:
    system, name = _file(path)
    if system is None:
        shutil.rmtree(name, ignore_errors=True)
    else:
        system.delete_dir(name)


def _move(path: str, to: str) -> None:
    (system, name), (_, target) = _file(path), _file(to)
    if system is None:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        os.replace(name, target)
    else:
        system.create_dir(os.path.dirname(target), recursive=True)
        system.move(name, target)


@dataclass
class _Part(WriterCommitMessage):
    path: str
    rows: int


class _KffWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.k, self.align, self.single = options["path"], int(options["k"]), options.get("align", "left"), options.get("single", "true") == "true"
        self.parts = f"{self.path}.parts-{options['run']}"

    def write(self, batches):
        """A part: the blocks of the task's rows (or a file of them). Every attempt has a file of its own; only committed ones count."""
        part = _Part(f"{self.parts}/part-{uuid.uuid4().hex}", 0)
        with _create(part.path) as out:
            for batch in batches:
                if batch.num_rows:
                    counts = batch.column("count").to_numpy()
                    if counts.max() > 0xFFFFFFFF:
                        raise ValueError("a count does not fit in four bytes")
                    body = np.hstack([packed_rows(batch.column("kmer"), self.align), counts.astype(">u4").view(np.uint8).reshape(-1, 4)])
                    out.write(np.ascontiguousarray(body).tobytes())
                    part.rows += batch.num_rows
        if not self.single and part.rows:
            self._joined(f"{part.path}.kff", [part])
        return part

    def _joined(self, path, parts):
        with _create(path) as out:
            out.write(kff_head(self.k) + struct.pack(">Q", sum(m.rows for m in parts)))
            for m in parts:
                with open_file(m.path, unpack=False) as part:
                    shutil.copyfileobj(part, out, 1 << 20)
            out.write(b"KFF")

    def commit(self, messages):
        """One file of all parts, or the tasks' files moved to the folder."""
        parts = [m for m in messages if m is not None]
        if self.single:
            self._joined(self.path, parts)
        else:
            for m in parts:
                if m.rows:
                    _move(f"{m.path}.kff", f"{self.path}/{m.path.rpartition('/')[2]}.kff")
        _remove(self.parts)

    def abort(self, messages):
        _remove(self.parts)


class KffSink(DataSource):
    @classmethod
    def name(cls):
        return "kff"

    def schema(self):
        return "kmer string, count long"

    def reader(self, schema):
        return _KffReader(self.options)

    def writer(self, schema, overwrite):
        return _KffWriter(self.options)


def write_kff(counts: DataFrame, path: str, k: int | None = None, align: str = "left", single: bool = True) -> None:
    """KFF 1.0: unique canonical k-mers in a raw section, big-endian 4-byte counts; counts over 2**32 - 1 are an error.

    single: one file, joined from the tasks' parts; else path is a folder of one file for each task. Paths are local
    (on a cluster: of a shared mount) or the URI of a file system that Arrow opens. k is needed for an empty result only.
    """
    spark = counts.sparkSession
    if k is None:
        first = counts.select("kmer").first()
        k = len(first[0]) if first else 1
    spark.dataSource.register(KffSink)
    rows = counts.select("kmer", F.col("count").cast("long").alias("count"))
    rows.write.format("kff").mode("append").options(path=path, k=k, align=align, single=str(single).lower(), run=uuid.uuid4().hex).save()


class Kff:
    """Where the blocks of a KFF file that write_kff made stand: k, rows, first byte, bytes of a row."""

    def __init__(self, path: str):
        with open_file(path, unpack=False) as f:
            head = f.read(12)
            if head[:3] != b"KFF":
                raise ValueError(f"no KFF file: {path}")
            f.read(struct.unpack(">I", head[8:12])[0])
            if f.read(1) != b"v":
                raise ValueError("expected a section of variables")
            variables = {}
            for _ in range(struct.unpack(">Q", f.read(8))[0]):
                name = b""
                while (c := f.read(1)) != b"\0":
                    name += c
                variables[name.decode()] = struct.unpack(">Q", f.read(8))[0]
            if f.read(1) != b"r":
                raise ValueError("expected a raw section")
            self.k, self.rows, self.first = variables["k"], struct.unpack(">Q", f.read(8))[0], f.tell()
            self.width = -(-self.k // 4) + 4
            f.seek(self.first + self.rows * self.width)
            if f.read(3) != b"KFF":
                raise ValueError(f"a KFF file that is cut short: {path}")


class _KffReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.align = options["path"], options.get("align", "left")

    def partitions(self):
        self.kff = Kff(self.path)
        step = max(1, SPLIT // self.kff.width)
        return [InputPartition((a, min(a + step, self.kff.rows))) for a in range(0, self.kff.rows, step)] or [InputPartition((0, 0))]

    def read(self, part):
        kff, (at, end) = Kff(self.path), part.value
        with open_file(self.path, unpack=False) as f:
            f.seek(kff.first + at * kff.width)
            while at < end:
                n = min(end - at, 1 << 16)
                rows = np.frombuffer(f.read(n * kff.width), np.uint8).reshape(n, kff.width)
                codes, _ = bases.unpack_all(rows[:, :-4].ravel(), np.full(n, 4 * (kff.width - 4)))
                codes = codes.reshape(n, -1)
                codes = codes[:, : kff.k] if self.align == "left" else codes[:, codes.shape[1] - kff.k :]
                counts = np.ascontiguousarray(rows[:, -4:]).view(">u4").ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays([bases.string_array(bases.LETTER[codes]), pa.array(counts)], names=["kmer", "count"])
                at += n


def read_kff(spark: SparkSession, path: str, align: str = "left") -> DataFrame:
    """kmer, count of a file that write_kff made, read in ranges of rows."""
    spark.dataSource.register(KffSink)
    return spark.read.format("kff").options(path=path, align=align).load()


def write_debug(table: DataFrame, path: str) -> None:
    """A diagnostics table as CSV with a header, in one directory."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
