"""The registered queries of the k-mer operators and their SQL for DuckDB.

The tables hold prose, so the texts of documents are recoded: letters become bases
cyclically. Recipe A keeps other characters as breaks (short runs), recipe B removes
them (one run for each document).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import bases, seqops
from strandlake.operators import count, minimizers
from strandlake.plans import vector
from strandlake.sources import fastx, sinks

K, M, PARTS = 7, 5, 16
_SRC, _DST = seqops._LETTERS, seqops.RECODED
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _docs(spark: SparkSession, sf_dir: str, keep_breaks: bool = True) -> DataFrame:
    """doc_id, lang, seq. A local session spreads a table of few files, each read as one partition, over its cores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    n = spark.sparkContext.defaultParallelism
    if spark.sparkContext.master.startswith("local[") and len(docs.inputFiles()) < n:
        docs = docs.repartition(n)
    return docs.select("doc_id", "lang", seqops.recode("text", keep_breaks).alias("seq"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_A = f"""with recursive d as (select doc_id, lang, translate(text, '{_SRC}', '{_DST}') as seq from documents),
e as (select doc_id, lang, regexp_extract_all(seq, '[ACGT]+') as l from d),
r as (select doc_id, lang, unnest(l) as run, generate_subscripts(l, 1) - 1 as run_id from e)"""
_B = f"""with recursive r as (select doc_id, lang, 0 as run_id, regexp_replace(translate(text, '{_SRC}', '{_DST}'), '[^ACGT]', '', 'g') as run from documents)"""


def _windows(k: int, more: str = "") -> str:
    """CTE w: every window of k bases of r's runs."""
    return f""", w as (select doc_id, lang, run_id, cast(i as bigint) as pos, substr(run, cast(i + 1 as bigint), {k}) as kmer
  from (select *, unnest(range(0, length(run) - {k} + 1)) as i from r where length(run) >= {k})){more}"""


def _canon(c: str) -> str:
    return f"least({c}, reverse(translate({c}, 'ACGT', 'TGCA')))"


def _counts(k: int) -> str:
    return _windows(k) + f", c as (select {_canon('kmer')} as kmer, count(*) as count from w group by 1)"


# hashes of m-mers: the XOR of constants by place and base
_CONST = ", ".join(f"({i}, '{b}', {v}::ubigint)" for i, b, v in bases.nthash_constants(M))
_HASHES = f""", k0(i, b, v) as (values {_CONST}),
mm as (select doc_id, run_id, pos, bit_xor(v) as h from (select doc_id, run_id, pos, unnest(range(0, {M})) as i, kmer from w) x
  join k0 on k0.i = x.i and k0.b = substr(x.kmer, cast(x.i + 1 as bigint), 1) group by all),
z0 as (select doc_id, run_id, pos, min(h) over (partition by doc_id, run_id order by pos rows between current row and {K - M} following) as h,
  count(*) over (partition by doc_id, run_id) as n from mm),
z as (select doc_id, run_id, pos, h from z0 where pos < n - {K - M})"""
_MINI = _A + _windows(M) + _HASHES
_ISLANDS = """, g as (select *, case when lag(h) over p = h then 0 else 1 end as new from z window p as (partition by doc_id, run_id order by pos)),
g2 as (select *, sum(new) over (partition by doc_id, run_id order by pos) as island from g),
i0 as (select doc_id, run_id, island, min(pos) as pos, count(*) as c, any_value(h) as h from g2 group by all)"""
_ROOM = minimizers.longest(K, M) - K + 1
_COVER = _MINI + ", cov as (select h, count(*) as coverage from z group by 1)"
_BYMIN = _MINI + f""", kw as (select doc_id, run_id, pos, kmer from (select doc_id, run_id, cast(i as bigint) as pos, substr(run, cast(i + 1 as bigint), {K}) as kmer
  from (select *, unnest(range(0, length(run) - {K} + 1)) as i from r where length(run) >= {K}))),
kc as (select {_canon('kmer')} as kmer, count(*) as count, any_value(h) as h from kw join z using (doc_id, run_id, pos) group by 1),
pt as (select cast(h & {PARTS - 1} as integer) as partition_id, cast(sum(count) as bigint) as n_inserted, count(*) as n_unique from kc group by 1)"""


@query(_A + " select doc_id, cast(run_id as integer) as run_id, run from r")
def acgt_runs(spark, sf_dir):
    return seqops.runs(_docs(spark, sf_dir), "seq", "doc_id")


@query(_A + f" select count(*) as seqs, cast(sum(greatest(length(run) - {K - 1}, 0)) as bigint) as kmers from r")
def run_stats(spark, sf_dir):
    return count.run_stats(_docs(spark, sf_dir), K)


@query(_A + _windows(K) + " select doc_id, cast(run_id as integer) as run_id, pos, kmer from w")
def kmer_windows(spark, sf_dir):
    return _kmers(spark, sf_dir).select("doc_id", "run_id", F.col("pos").cast("long").alias("pos"), "kmer")


def _kmers(spark, sf_dir, k: int = K):
    return seqops.kmers(seqops.runs(_docs(spark, sf_dir), "seq", "doc_id"), k, "doc_id", "run_id")


@query(_A + _windows(K) + " select kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) as rc, count(*) as n from w group by 1, 2")
def revcomp(spark, sf_dir):
    return _kmers(spark, sf_dir).groupBy("kmer", seqops.revcomp("kmer").alias("rc")).agg(F.count(F.lit(1)).alias("n"))


@query(_A + _windows(K) + f" select kmer, {_canon('kmer')} as canonical, kmer = {_canon('kmer')} as is_canonical, count(*) as n from w group by all")
def canonical_kmers(spark, sf_dir):
    return _kmers(spark, sf_dir).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).select("kmer", seqops.canonical("kmer").alias("canonical"), seqops.in_canonical_form("kmer").alias("is_canonical"), "n")


@query(_A + _counts(7) + " select kmer, count from c")
def kmer_count_k7(spark, sf_dir):
    return count.count_kmers(spark, _docs(spark, sf_dir), 7, 5)


@query(_B + _counts(31) + " select kmer, count from c")
def kmer_count_k31(spark, sf_dir):
    return count.count_kmers(spark, _docs(spark, sf_dir, False), 31, 21)


@query(_B + _counts(8) + " select kmer, count from c")
def kmer_count_even_k8(spark, sf_dir):
    return count.count_kmers(spark, _docs(spark, sf_dir, False), 8, 5)


@query(_B + _counts(63) + " select kmer, count from c")
def kmer_count_k63(spark, sf_dir):
    return count.count_kmers(spark, _docs(spark, sf_dir, False), 63, 21)


@query(_A + _counts(7) + " select kmer, count from c")
def kmer_count_sql_plan(spark, sf_dir):
    return count.count_kmers(spark, _docs(spark, sf_dir), 7, 5, plan="sql")


@query(_B + _counts(21) + " select kmer, count from c")
def kmer_count_minimizer_plan(spark, sf_dir):
    return count.count_kmers(spark, _docs(spark, sf_dir, False), 21, 11, plan="minimizer")


@query(_A + _counts(7) + " select kmer, count from c where count >= 2")
def count_filter_ci2(spark, sf_dir):
    return count.count_kmers(spark, _docs(spark, sf_dir), 7, 5, min_count=2)


@query(_A + _counts(7) + " select kmer, count from c where count between 3 and 50")
def count_filter_ci_cx(spark, sf_dir):
    return count.count_kmers(spark, _docs(spark, sf_dir), 7, 5, min_count=3, max_count=50)


@query(_A + _windows(7) + f" select lang, {_canon('kmer')} as kmer, count(*) as count from w group by 1, 2")
def count_by_file(spark, sf_dir):
    rows = seqops.kmers(seqops.runs(_docs(spark, sf_dir), "seq", "lang"), 7, "lang")
    return rows.groupBy("lang", seqops.canonical("kmer").alias("kmer")).agg(F.count(F.lit(1)).alias("count"))


def _k7(spark, sf_dir):
    return count.count_kmers(spark, _docs(spark, sf_dir), K, M)


_DIGITS = " + ".join(f"(strpos('ACGT', substr(kmer, {i + 1}, 1)) - 1) * {4 ** (K - 1 - i)}" for i in range(K))


@query(_A + _counts(K) + f" select kmer, cast({_DIGITS} as bigint) as value, kmer as decoded from c")
def kmer_int_encode(spark, sf_dir):
    return _k7(spark, sf_dir).withColumn("value", seqops.encode("kmer")).select("kmer", "value", seqops.decode("value", K).alias("decoded"))


@query(_A + _counts(K) + f" select kmer, lower(printf('%04x', cast(({_DIGITS}) * 4 as integer))) as packed from c")
def kmer_pack_hex(spark, sf_dir):
    return _k7(spark, sf_dir).select("kmer", F.lower(seqops.pack_hex("kmer", K)).alias("packed"))


@query(_A + _counts(K) + f" select kmer, substr(kmer, 1, 1) as front, substr(kmer, {K}, 1) as back, substr(kmer, {K - 2}, 1) as at_2, substr(kmer, 3, 4) as lmer from c")
def base_at_front_back(spark, sf_dir):
    return _k7(spark, sf_dir).select("kmer", seqops.front("kmer").alias("front"), seqops.back("kmer").alias("back"), seqops.base_at("kmer", 2, K).alias("at_2"), seqops.lmer_at("kmer", 2, 4).alias("lmer"))


@query(_A + _counts(K) + f", n as (select kmer, substr(kmer, 2) || 'A' as following, 'T' || substr(kmer, 1, {K - 1}) as previous from c) select *, {_canon('following')} as following_canonical, {_canon('previous')} as previous_canonical from n")
def roll_next_prev(spark, sf_dir):
    rows = _k7(spark, sf_dir).select("kmer", seqops.roll_next("kmer", F.lit("A")).alias("following"), seqops.roll_prev("kmer", F.lit("T")).alias("previous"))
    return rows.select("*", seqops.canonical("following").alias("following_canonical"), seqops.canonical("previous").alias("previous_canonical"))


@query(_A + _counts(K + 1) + f" select kmer as edge, substr(kmer, 1, {K}) as prefix, substr(kmer, 2) as suffix, reverse(kmer) as reversed from c")
def kplus1_prefix_suffix(spark, sf_dir):
    rows = count.count_kmers(spark, _docs(spark, sf_dir), K + 1, M)
    return rows.select(F.col("kmer").alias("edge"), seqops.from_prefix("kmer").alias("prefix"), seqops.from_suffix("kmer").alias("suffix"), seqops.base_reverse("kmer").alias("reversed"))


@query(_A + _counts(K) + " select kmer from c")
def distinct_kmers(spark, sf_dir):
    return count.distinct_kmers(_docs(spark, sf_dir), K)


@query(_A + _windows(K) + f", c as (select {_canon('kmer')} as kmer, count(*) as count from w group by 1), q(query) as (values ('ACGTACG'), ('TTTTTTT'), ('AAAAAAA'), ('GATTACA'), ('CCCCCCC')) select query, {_canon('query')} as kmer, coalesce(count, 0) as count from q left join c on c.kmer = {_canon('query')}")
def kmer_lookup(spark, sf_dir):
    wanted = spark.createDataFrame([(x,) for x in ("ACGTACG", "TTTTTTT", "AAAAAAA", "GATTACA", "CCCCCCC")], "kmer string")
    return count.lookup(_k7(spark, sf_dir), wanted)


@query(_A + _windows(K) + f" select {_canon('kmer')} as kmer, count(*) as n, count(distinct doc_id) as n_docs, min(pos) as first_pos, max(pos) as last_pos from w group by 1")
def keyed_reduce(spark, sf_dir):
    return count.reduce_by_kmer(_kmers(spark, sf_dir), F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"))


def _run_rows(spark, sf_dir):
    return seqops.runs(_docs(spark, sf_dir), "seq", "doc_id").withColumnRenamed("run", "seq")


@query(_A + _windows(M) + _HASHES + " select doc_id, cast(run_id as integer) as run_id, pos, lower(printf('%016x', h)) as hash from mm")
def mmer_nthash(spark, sf_dir):
    return minimizers.mmer_hashes(_run_rows(spark, sf_dir), M, "doc_id", "run_id").select("doc_id", "run_id", "pos", minimizers.hash_hex("hash").alias("hash"))


def _minimizers(spark, sf_dir):
    return minimizers.minimizers(_run_rows(spark, sf_dir), K, M, "doc_id", "run_id")


@query(_MINI + " select doc_id, cast(run_id as integer) as run_id, pos, lower(printf('%016x', h)) as minimizer from z")
def minimizer_windows(spark, sf_dir):
    return _minimizers(spark, sf_dir).select("doc_id", "run_id", "pos", minimizers.hash_hex("minimizer").alias("minimizer"))


@query(_MINI + f" select cast(h & {PARTS - 1} as integer) as pid, count(*) as n from z group by 1")
def partition_ids(spark, sf_dir):
    return _minimizers(spark, sf_dir).groupBy(minimizers.partition_of("minimizer", PARTS).alias("pid")).agg(F.count(F.lit(1)).alias("n"))


@query(_MINI + _ISLANDS + f""", s as (select doc_id, run_id, h, pos + j * {_ROOM} as pos, least(c - j * {_ROOM}, {_ROOM}) + {K - 1} as n_bases from (select *, unnest(range(0, (c + {_ROOM - 1}) // {_ROOM})) as j from i0))
select doc_id, cast(run_id as integer) as run_id, cast(pos as bigint) as pos, cast(n_bases as integer) as n_bases, lower(printf('%016x', h)) as minimizer from s""")
def superkmers(spark, sf_dir):
    return minimizers.superkmers(_run_rows(spark, sf_dir), K, M, "doc_id", "run_id").select("doc_id", "run_id", "pos", "n_bases", minimizers.hash_hex("minimizer").alias("minimizer"))


@query(_MINI + _ISLANDS + f" select (select count(*) from r) as seqs, cast(sum(c) as bigint) as kmers, cast(sum((c + {_ROOM - 1}) // {_ROOM}) as bigint) as superkmers from i0")
def partition_only_stats(spark, sf_dir):
    return minimizers.run_stats(_docs(spark, sf_dir), K, M)


def _coverage(spark, sf_dir):
    return minimizers.coverage(_docs(spark, sf_dir), K, M)


@query(_COVER + " select lower(printf('%016x', h)) as minimizer, coverage from cov")
def minimizer_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir).select(minimizers.hash_hex("minimizer").alias("minimizer"), "coverage")


@query(_COVER + " select coverage, count(*) as n_minimizers, cast(sum(coverage) as bigint) as total_kmers from cov group by 1")
def coverage_hist(spark, sf_dir):
    return minimizers.coverage_histogram(_coverage(spark, sf_dir))


@query(_COVER + " select count(*) as n_minimizers, cast(sum(coverage) as bigint) as total_kmers, sum(coverage)::double / count(*) as avg_coverage, max(coverage) as max_coverage from cov")
def coverage_summary(spark, sf_dir):
    return minimizers.coverage_summary(_coverage(spark, sf_dir))


@query(_COVER + " select cast(h >> 56 as integer) as bin, cast(sum(coverage) as bigint) as kmers from cov group by 1 order by 2 desc, 1 limit 20")
def hot_minimizer_bins(spark, sf_dir):
    return minimizers.hot_bins(_coverage(spark, sf_dir))


@query(_BYMIN + " select * from pt")
def partition_stats(spark, sf_dir):
    return minimizers.partition_table(_docs(spark, sf_dir), K, M, PARTS)


@query(_BYMIN + " select " + ", ".join(f"cast({f}({c}) as double) as {n}_{c}" for c in ("n_inserted", "n_unique") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + " from pt")
def partition_summary(spark, sf_dir):
    return minimizers.partition_summary(partition_stats(spark, sf_dir))


@query(_BYMIN + " select * from pt order by n_inserted desc, partition_id limit 10")
def largest_partitions(spark, sf_dir):
    return minimizers.largest_partitions(partition_stats(spark, sf_dir))


@query(f"select doc_id, length(text) - length(translate(text, 'Nn', '')) as n_mask, length(regexp_replace(text, '[^ACGTacgt]', '', 'g')) as n_bases, length(text) - length(regexp_replace(text, '[^ACGTacgt]', '', 'g')) as non_acgt from documents")
def n_mask_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", seqops.count_of("text", "Nn").alias("n_mask"), (F.length("text") - seqops.count_non_acgt("text")).cast("long").alias("n_bases"), seqops.count_non_acgt("text").alias("non_acgt"))


@query(_A + _windows(K) + f", x as (select kmer, {_canon('kmer')} as c, min(pos) as p from w group by 1, 2) select c as kmer, count(*) as strands, bool_or(kmer = c) as seen_forward from x group by 1")
def directed_vertices(spark, sf_dir):
    rows = _kmers(spark, sf_dir).groupBy("kmer").agg(F.min("pos").alias("p"))
    return rows.groupBy(seqops.canonical("kmer").alias("c")).agg(F.count(F.lit(1)).alias("strands"), F.bool_or(seqops.in_canonical_form("kmer")).alias("seen_forward")).withColumnRenamed("c", "kmer")


@query(f"""with l as (select unnest(string_split(text, '')) as c from documents)
select upper(c) as letter, cast(strpos('ACGT', upper(c)) - 1 as integer) as code,
  case when regexp_matches(c, '^[ACGTacgt]$') then translate(upper(c), 'ACGT', 'TGCA') else 'N' end as complement, count(*) as n
from l where regexp_matches(c, '^[A-Za-z]$') group by all""")
def base_codes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = vector.letter_counts(docs, "text")
    return rows.groupBy(F.upper("c").alias("letter"), F.coalesce(seqops.base_code("c"), F.lit(-1)).alias("code"), seqops.complement("c").alias("complement")).agg(F.sum("n").alias("n"))


# sources and sinks: the recoded documents as files of a folder that all executors share, and what is read back


def _folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local session makes its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def _written(spark: SparkSession, sf_dir: str, record, keep_breaks: bool = False, compression: str = "none") -> str:
    """The folder of text files with record(doc_id, seq) of every document."""
    folder = _folder(spark)
    rows = _docs(spark, sf_dir, keep_breaks).withColumn("seq", F.coalesce(F.translate("seq", "\n\r>", "NNN"), F.lit("")))
    rows.select(record(F.col("doc_id").cast("string"), F.col("seq")).alias("value")).write.option("compression", compression).text(folder)
    return folder


def _fasta(doc, seq):
    """Lines of 60 bases."""
    return F.concat(F.lit(">"), doc, F.lit(" a>b\n"), F.regexp_replace(seq, "(.{60})", "$1\n"))


def _fastq(doc, seq):
    return F.concat(F.lit("@"), doc, F.lit("\n"), seq, F.lit("\n+\n"), F.repeat(F.lit("@"), F.length(seq)))


@query(_B + _counts(9) + " select kmer, count from c")
def fasta_count(spark, sf_dir):
    return count.count_kmers(spark, _written(spark, sf_dir, _fasta), 9, 5)


@query(_B + _counts(9) + " select kmer, count from c")
def fasta_gz_count(spark, sf_dir):
    return count.count_kmers(spark, _written(spark, sf_dir, _fasta, compression="gzip"), 9, 5, plan="minimizer")


@query(_B + " select cast(doc_id as varchar) as header, run as seq, repeat('@', length(run)) as quality, cast(length(run) as bigint) as n_bases from r")
def fastq_records(spark, sf_dir):
    rows = fastx.read(spark, _written(spark, sf_dir, _fastq), columns=("header", "seq", "quality"))
    return rows.withColumn("n_bases", F.length("seq").cast("long"))


@query(_B + " select cast(doc_id as varchar) as header, run as seq, repeat('@', length(run)) as quality from r")
def fastq_gz_records(spark, sf_dir):
    return fastx.read(spark, _written(spark, sf_dir, _fastq, compression="gzip"), columns=("header", "seq", "quality"))


@query(_A + " select cast(doc_id as varchar) || ' a>b' as header, run from r")
def fasta_split_runs(spark, sf_dir):
    folder = _written(spark, sf_dir, lambda doc, seq: F.concat(F.lit(">"), doc, F.lit(" a>b\n"), seq), keep_breaks=True)
    return fastx.read(spark, folder, columns=("header", "seq"), non_bases="split").withColumnRenamed("seq", "run")


@query(_B + " select cast(doc_id as varchar) || ' a>b' as header, run as seq from r")
def fasta_skip_non_bases(spark, sf_dir):
    folder = _written(spark, sf_dir, lambda doc, seq: F.concat(F.lit(">"), doc, F.lit(" a>b\n"), seq), keep_breaks=True)
    return fastx.read(spark, folder, columns=("header", "seq"), non_bases="skip")


@query(_A + f" select count(*) as seqs, cast(sum(greatest(length(run) - {K - 1}, 0)) as bigint) as kmers from r")
def file_list_stats(spark, sf_dir):
    folder = _written(spark, sf_dir, lambda doc, seq: F.concat(F.lit(">"), doc, F.lit("\n"), seq), keep_breaks=True)
    names = spark.createDataFrame([(name,) for name in fastx.expand(folder)], "value string")
    listed = _folder(spark)
    names.coalesce(1).write.text(listed)
    return count.run_stats(count.sequences(spark, "@" + fastx.expand(listed)[0]), K)


@query(_A + _counts(7) + " select kmer, count from c")
def tsv_round_trip(spark, sf_dir):
    path = _folder(spark) + ".tsv"
    sinks.write_counts(_k7(spark, sf_dir), path)
    return spark.read.option("sep", "\t").schema("kmer string, count long").csv(path)


@query(_A + _counts(7) + " select kmer, count from c")
def kff_round_trip(spark, sf_dir):
    path = _folder(spark) + ".kff"
    sinks.write_counts(_k7(spark, sf_dir), path, K)
    return sinks.read_kff(spark, path)


@query(_A + _counts(7) + " select kmer, count from c")
def parquet_round_trip(spark, sf_dir):
    path = _folder(spark) + ".parquet"
    sinks.write_counts(_k7(spark, sf_dir), path)
    return spark.read.parquet(path)


# places of minimizers, windows with all that is known of them, packed super-k-mers, 32 bases


@query(_MINI + _ISLANDS + f""", s as (select doc_id, run_id, h, pos + j * {_ROOM} as pos, least(c - j * {_ROOM}, {_ROOM}) + {K - 1} as n_bases from (select *, unnest(range(0, (c + {_ROOM - 1}) // {_ROOM})) as j from i0))
select doc_id, cast(s.run_id as integer) as run_id, cast(s.pos as bigint) as pos, cast(min(mm.pos) - s.pos as integer) as min_pos, any_value(substr(run, cast(s.pos + 1 as bigint), {K})) as first_kmer
from s join mm using (doc_id, run_id) join r using (doc_id, run_id) where mm.h = s.h and mm.pos between s.pos and s.pos + {K - M} group by doc_id, s.run_id, s.pos""")
def superkmer_heads(spark, sf_dir):
    rows = minimizers.superkmers(_run_rows(spark, sf_dir), K, M, "doc_id", "run_id", packed=True, positions=True)
    return rows.select("doc_id", "run_id", "pos", "min_pos", minimizers.first_kmer("sk", K).alias("first_kmer"))


@query(_MINI + f""", p as (select doc_id, run_id, z.pos as pos, z.h as h, min(mm.pos) as first from z join mm using (doc_id, run_id) where mm.h = z.h and mm.pos between z.pos and z.pos + {K - M} group by 1, 2, 3, 4),
v as (select doc_id, run_id, pos, h, first - pos as min_pos, substr(run, cast(pos + 1 as bigint), {K}) as kmer from p join r using (doc_id, run_id))
select doc_id, cast(run_id as integer) as run_id, cast(pos as bigint) as pos, kmer, {_canon('kmer')} as canonical, kmer = {_canon('kmer')} as is_forward, lower(printf('%016x', h)) as minimizer, cast(min_pos as integer) as min_pos from v""")
def vertex_windows(spark, sf_dir):
    return minimizers.vertices(_run_rows(spark, sf_dir), K, M, "doc_id", "run_id").withColumn("minimizer", minimizers.hash_hex("minimizer"))


_VALUE32 = " + ".join(f"(strpos('ACGT', substr(kmer, {i + 1}, 1)) - 1)::hugeint * {4 ** (31 - i)}::hugeint" for i in range(32))


@query(_B + _counts(32) + f", v as (select kmer, count, {_VALUE32} as v from c) select kmer, count, cast(case when v >= 9223372036854775808::hugeint then v - 18446744073709551616::hugeint else v end as bigint) as value, kmer as decoded from v")
def kmer_int_k32(spark, sf_dir):
    rows = count.count_kmers(spark, _docs(spark, sf_dir, False), 32, 21)
    return vector.valued(rows, 32)


@query("select doc_id, regexp_replace(regexp_replace(text, '[^ACGTacgt]', '1', 'g'), '[ACGTacgt]', '0', 'g') as mask, regexp_replace(regexp_replace(text, '[^Nn]', '0', 'g'), '[Nn]', '1', 'g') as n_mask from documents")
def masks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", seqops.mask_of("text").alias("mask"), seqops.mask_of("text", False).alias("n_mask"))
