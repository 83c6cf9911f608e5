"""Command line: count the k-mers of FASTA and FASTQ files."""

from __future__ import annotations

import argparse
import sys
import time

from strandlake import __version__


def _at_least(least: int, most: int | None = None):
    def check(text: str) -> int:
        value = int(text)
        if value < least or most is not None and value > most:
            raise argparse.ArgumentTypeError(f"{value} is not from {least} to {most if most is not None else 'infinity'}")
        return value

    return check


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake", description="Count canonical k-mers.")
    p.add_argument("inputs", nargs="+", help="FASTA or FASTQ files (.gz too), or @file with one path a line, then the output")
    p.add_argument("-k", type=_at_least(2, 256), default=31)
    p.add_argument("-m", type=_at_least(1, 32), default=21)
    p.add_argument("-n", type=_at_least(1), help="shuffle partitions")
    p.add_argument("-t", type=_at_least(1), default=4, help="threads of the local session")
    p.add_argument("-ci", type=_at_least(0), default=1, help="least count")
    p.add_argument("-cx", type=_at_least(0), help="greatest count")
    p.add_argument("-ram", type=_at_least(1), help="driver memory in GB")
    p.add_argument("-w", help="folder for temporary files")
    p.add_argument("-hp", action="store_true", help="hide progress")
    p.add_argument("-kt", action="store_true", help="ignored: temporary files are Spark's")
    p.add_argument("-tp", action="store_true", help="partition only: print seqs, kmers, superkmers")
    p.add_argument("-dbg", action="store_true", help="also write partition and minimizer tables")
    p.add_argument("-kff", action="store_true", help="write KFF (as does an output name in .kff)")
    p.add_argument("-v", "--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.m >= args.k:
        parser().error("m must be less than k")
    if not args.tp and len(args.inputs) < 2:
        parser().error("name the input and the output")
    from pyspark import StorageLevel
    from pyspark.sql import Observation, SparkSession
    from pyspark.sql import functions as F

    from strandlake.operators import count, minimizers
    from strandlake.sources import sinks

    if args.kt:
        print("-kt has no effect", file=sys.stderr)
    if spark is None:
        build = SparkSession.builder.master(f"local[{args.t}]").config("spark.ui.showConsoleProgress", not args.hp)
        for key, value in (("spark.sql.shuffle.partitions", args.n), ("spark.driver.memory", args.ram and f"{args.ram}g"), ("spark.local.dir", args.w)):
            build = build.config(key, value) if value else build
        spark = build.getOrCreate()
    files, out = (args.inputs, None) if args.tp else (args.inputs[:-1], args.inputs[-1])
    df = count.sequences(spark, files)
    n = args.n and 1 << (args.n - 1).bit_length() or minimizers.default_partitions(df)
    say = lambda **values: [print(f"{key}: {value:.2f}" if isinstance(value, float) else f"{key}: {value}", file=sys.stderr) for key, value in values.items()]
    began = time.time()
    say(**minimizers.run_stats(df, args.k, args.m).first().asDict(), phase1=time.time() - began, n_parts=n)
    if args.tp:
        return 0
    if args.kff and not out.endswith(".kff"):
        out += ".kff"
    began, seen = time.time(), Observation()
    every = count.count_kmers(spark, files, args.k, args.m)
    if args.dbg:
        every = every.persist(StorageLevel.DISK_ONLY)  # written and described, counted once
    counts = count.in_range(every, args.ci, args.cx).observe(seen, F.count(F.lit(1)).alias("n"))
    sinks.write_counts(counts, out, args.k)
    say(phase2=time.time() - began, unique_kmers=seen.get["n"])
    if args.dbg:
        covered = minimizers.coverage(df, args.k, args.m)
        sinks.write_debug(minimizers.partition_table(df, args.k, args.m, n, counted=every).orderBy("partition_id"), out + ".debug_table_stats")
        sinks.write_debug(minimizers.coverage_histogram(covered), out + ".debug_min_coverage")
        say(**{f"dbg_{key}": value for key, value in minimizers.coverage_summary(covered).first().asDict().items()})
        every.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
