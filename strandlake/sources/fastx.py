"""FASTA and FASTQ files, plain or gzipped, as a Spark data source.

Rows are (file, record_id, header, seq, quality), or those of these columns that are asked for:
others are not decoded. seq is the record's text without line feeds; characters that are no bases
stay and end runs later, unless the option `non_bases` skips them or splits records there. A
file whose first byte is `@` is FASTQ in strict records of four lines, any other FASTA; a name of
over three characters that ends in `.gz` is gzip. Text before the first `>` is ignored, a `>`
anywhere but in a header starts a header, and a carriage return is an ordinary character.

Paths are local or the URI of any file system that Arrow opens (file, hdfs, s3, gs). Plain files are cut into
ranges of SPLIT bytes: a FASTA range starts at the first line that begins with `>`, a FASTQ range at the first
line that begins with `@` two lines before one with `+`. A gzip file is one partition; operators spread
its records over the cores after the parse (see operators.count.spread).
"""

from __future__ import annotations

import gzip
import io
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 64 << 20
#: Bytes of one Arrow batch of records.
BATCH = 4 << 20
COLUMNS = {"file": "string", "record_id": "long", "header": "string", "seq": "string", "quality": "string"}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())


def schema_of(columns) -> str:
    return ", ".join(f"{c} {COLUMNS[c]}" for c in columns)


def expand(paths) -> list[str]:
    """The files named, where `@list` names a file with one path a line (blank lines skipped, ~ expanded), and a folder
    stands for its files whose names begin with neither . nor _."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = []
    for path in map(str, paths):
        if path.startswith("@"):
            with open_file(os.path.expanduser(path[1:]), unpack=False) as lines:
                out += [os.path.expanduser(x.decode().strip()) for x in lines if x.strip()]
        else:
            out += _files_of(path)
    if not out:
        raise ValueError("no input files")
    return out


def _file(path: str):
    """(file system or None, path there): None is the local one."""
    if path.startswith("file:/"):
        return None, "/" + path[6:].lstrip("/")
    if "://" not in path:
        return None, path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _files_of(path: str) -> list[str]:
    from pyarrow import fs

    system, name = _file(path)
    system = system or fs.LocalFileSystem()
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = sorted(x.path for x in system.get_file_info(fs.FileSelector(name)) if x.is_file and x.base_name[:1] not in "._" and x.size)
    return [f"{path.rstrip('/')}/{x.rpartition('/')[2]}" for x in found]


def size_of(path: str) -> int | None:
    """Bytes of a file; None where there is none."""
    system, name = _file(path)
    if system is None:
        return os.path.getsize(name) if os.path.isfile(name) else None
    return system.get_file_info(name).size


def open_file(path: str, unpack: bool = True):
    """An open, seekable binary file; gzip is unpacked."""
    system, name = _file(path)
    raw = open(name, "rb") if system is None else io.BufferedReader(system.open_input_file(name), 1 << 20)
    return gzip.GzipFile(fileobj=raw) if unpack and is_gzip(path) else raw


def is_gzip(path: str) -> bool:
    return len(path) > 3 and path.endswith(".gz")


def read(spark: SparkSession, paths, keep_carriage_returns: bool = True, columns=tuple(COLUMNS), non_bases: str = "keep") -> DataFrame:
    """The records of files. columns: which of the columns there are; non_bases: `keep`, `skip` (left out of seq)
    or `split` (a row for each run of bases, with the record's other columns; quality is null then)."""
    files, columns = expand(paths), list(columns)
    if not columns or set(columns) - set(COLUMNS):
        raise ValueError(f"columns must be of {tuple(COLUMNS)}")
    if non_bases not in ("keep", "skip", "split"):
        raise ValueError("non_bases must be keep, skip or split")
    for file in files:
        if size_of(file) is None:
            raise FileNotFoundError(file)
    spark.dataSource.register(FastxSource)
    options = {"paths": json.dumps(files), "columns": json.dumps(columns), "crlf": "keep" if keep_carriage_returns else "strip", "non_bases": non_bases}
    return spark.read.format("fastx").options(**options).load()


def fasta_records(f, start: int = 0, end: int | None = None):
    """(header, seq) of the records of an open binary file that start, on a line of their own, from start up to end.

    The first range also owns headers in the middle of its first line.
    """
    at = max(start - 1, 0)
    f.seek(at)
    if start:  # a record belongs to the range that its line start is in
        at += len(f.readline())
    header, parts, owned = None, [], start == 0
    for line in f:
        if line[:1] == b">" and end is not None and at >= end:
            break
        if line[:1] == b">":
            owned = True
        at += len(line)
        if not owned:
            continue
        mark = line.find(b">")
        text = line if mark < 0 else line[:mark]
        if header is not None and text:
            parts.append(text[:-1] if text.endswith(b"\n") else text)
        if mark >= 0:
            if header is not None:
                yield header, b"".join(parts)
            header, parts = line[mark + 1 :].rstrip(b"\n"), []
    if header is not None:
        yield header, b"".join(parts)


def fastq_records(f, start: int = 0, end: int | None = None):
    """(header, seq, quality) of the strict records of four lines that start from start up to end; a last record may be cut short."""
    at = max(start - 1, 0)
    f.seek(at)
    lines: list[bytes] = []
    if start:  # a quality may begin with @ too, but no line two below it with +
        at += len(f.readline())
        while True:
            while len(lines) < 3 and (line := f.readline()):
                lines.append(line)
            if not lines or lines[0][:1] == b"@" and (len(lines) < 3 or lines[2][:1] == b"+"):
                break
            at += len(lines.pop(0))
    while end is None or at < end:
        while len(lines) < 4 and (line := f.readline()):
            lines.append(line)
        if not lines:
            return
        at += sum(map(len, lines))
        header, seq, _, quality = (x.rstrip(b"\n") for x in (*lines, b"", b"", b"")[:4])
        yield header[1:], seq, quality
        lines = []


class _Range(InputPartition):
    def __init__(self, file, start, end, fastq):
        self.file, self.start, self.end, self.fastq = file, start, end, fastq


def ranges(files: list[str]) -> list[_Range]:
    """What one task each reads."""
    out = []
    for file in files:
        with open_file(file) as f:
            first = f.read(1)
        if not first:
            raise ValueError(f"Cannot read {file}" if is_gzip(file) else f"Empty file: {file}")
        size = size_of(file)
        if is_gzip(file) or size <= SPLIT:
            out.append(_Range(file, 0, None, first == b"@"))
        else:
            out += [_Range(file, a, min(a + SPLIT, size), first == b"@") for a in range(0, size, SPLIT)]
    return out


_RUNS = re.compile(rb"[ACGTacgt]+").findall


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["paths"]) if "paths" in options else expand(options["path"])
        self.columns = json.loads(options["columns"]) if "columns" in options else list(COLUMNS)
        self.strip, self.non_bases = options.get("crlf") == "strip", options.get("non_bases", "keep")

    def partitions(self):
        return ranges(self.files)

    def _texts(self, seq: bytes) -> list[bytes]:
        if self.strip:
            seq = seq.replace(b"\r", b"")
        if self.non_bases == "keep":
            return [seq]
        runs = _RUNS(seq)
        return runs if self.non_bases == "split" else [b"".join(runs)]

    def read(self, part):
        text = lambda b: b.decode("utf-8", "replace")
        kinds = {"record_id": pa.int64()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), schema)], schema=schema)

        with open_file(part.file) as f:
            records = fastq_records(f, part.start, part.end) if part.fastq else ((h, s, None) for h, s in fasta_records(f, part.start, part.end))
            for i, (header, seq, quality) in enumerate(records):
                whole = {"file": lambda: part.file, "record_id": lambda: part.start + i, "header": lambda: text(header), "quality": lambda: None if quality is None or self.non_bases == "split" else text(quality)}  # ids are unique in the file: records of a range are fewer than its bytes
                own = [whole[c]() if c in whole else None for c in self.columns]
                for body in self._texts(seq):
                    rows.append([text(body) if c == "seq" else v for c, v in zip(self.columns, own)])
                    size += len(body) + 64
                    if size >= BATCH:
                        yield batch()
                        rows, size = [], 0
            if rows:
                yield batch()


class FastxSource(DataSource):
    @classmethod
    def name(cls):
        return "fastx"

    def schema(self):
        return schema_of(json.loads(self.options["columns"])) if "columns" in self.options else SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
