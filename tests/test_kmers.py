import gzip
import random
from collections import Counter

import numpy as np
import pytest
from brute import count as brute_count
from brute import minimizer, nthash, rc, runs, superkmers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import bases, seqops
from strandlake.operators import count, minimizers
from strandlake.plans import vector

KS = (2, 7, 8, 21, 31, 32, 33, 63, 127, 256)


def dna(n, seed, alphabet="ACGTacgtN\r "):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) if r.random() < 0.02 else r.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def reads(spark):
    texts = [dna(n, n) for n in (0, 1, 5, 40, 300, 700, 1500)] + ["A" * 900, "acgt" * 80, None, "ACGT" * 100]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, seq string").repartition(3).cache()


@pytest.mark.parametrize("k", KS)
def test_vector_plan_counts_as_brute_force(reads, spark, k):
    texts, df = reads
    expected = brute_count([t or "" for t in texts], k)
    assert count.collect_dict(count.count_kmers(spark, df, k, min(21, k - 1), plan="vector")) == expected
    assert count.collect_dict(count.count_kmers(spark, df, k, min(21, k - 1))) == expected


@pytest.mark.parametrize("k,m", [(2, 1), (7, 4), (31, 21), (33, 11), (63, 32)])
def test_plans_agree(reads, spark, k, m):
    _, df = reads
    one = count.collect_dict(count.count_kmers(spark, df, k, m, plan="vector"))
    assert one == count.collect_dict(count.count_kmers(spark, df, k, m, plan="sql"))
    assert one == count.collect_dict(count.count_kmers(spark, df, k, m, plan="minimizer", partitions=8))


def test_sql_plan_cuts_long_runs_into_chunks(spark):
    text = dna(3 * seqops.CHUNK + 17, 3, "ACGT")
    df = spark.createDataFrame([(text,)], "seq string")
    assert count.collect_dict(count.count_kmers(spark, df, 31, 21, plan="sql")) == brute_count([text], 31)


def test_parts_of_a_batch_overlap(monkeypatch):
    text = dna(5000, 4)
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, 1200, 1200, 5000])
    found = [at + base for codes, ends, base in vector.slices(data, offsets, 31, 97) for at in bases.valid_windows(codes, ends, 31)]
    assert found == bases.valid_windows(bases.CODE[data], offsets, 31).tolist()


def test_filters_and_arguments(reads, spark):
    texts, df = reads
    every = brute_count([t or "" for t in texts], 5)
    kept = count.collect_dict(count.count_kmers(spark, df, 5, 3, min_count=3, max_count=9))
    assert kept == {w: n for w, n in every.items() if 3 <= n <= 9}
    assert count.collect_dict(count.count_kmers(spark, df, 5, 3, min_count=4, max_count=3)) == {}
    assert count.collect_dict(count.count_kmers(spark, df, 5, 3, min_count=0)) == every
    for k in (1, 257, "7", True):
        with pytest.raises(ValueError):
            count.count_kmers(spark, df, k)
    with pytest.raises(ValueError):
        seqops.check_km(9, 9)
    with pytest.raises(ValueError):
        count.count_kmers(spark, [], 7)
    for plan in count.PLANS:
        for k, m in ((5, 9), (5, 5), (5, 0), (40, 33)):
            with pytest.raises(ValueError):
                count.count_kmers(spark, df, k, m, plan=plan)
    assert count.collect_dict(count.count_kmers(spark, df, 5)) == every  # m is found where none is given


def test_strands_and_case_do_not_matter(spark):
    texts = [dna(200, s, "ACGT") for s in range(5)]
    make = lambda rows: spark.createDataFrame([(t,) for t in rows], "seq string")
    one = count.collect_dict(count.count_kmers(spark, make(texts), 11, 7))
    assert one == count.collect_dict(count.count_kmers(spark, make([rc(t) for t in reversed(texts)]), 11, 7))
    assert one == count.collect_dict(count.count_kmers(spark, make([t.lower() for t in texts]), 11, 7))
    assert sum(one.values()) == sum(len(t) - 10 for t in texts)


def test_stats_and_superkmers(reads, spark):
    texts, df = reads
    for k, m in ((7, 5), (31, 21), (200, 9)):
        longest = minimizers.longest(k, m)
        row = minimizers.run_stats(df, k, m).first()
        every = [r for t in texts for r in runs(t or "")]
        exp = [superkmers(r, k, m, longest) for r in every if len(r) < 400 or k < 100]
        assert row["seqs"] == len(every) and row["kmers"] == sum(max(len(r) - k + 1, 0) for r in every)
        if k < 100:
            assert row["superkmers"] == sum(map(len, exp))


@given(st.text("ACGTN", max_size=600))
@settings(max_examples=40, deadline=None)
def test_minimizer_kernels(text):
    data, k, m = np.frombuffer(text.encode(), np.uint8), 9, 4
    codes, offsets = bases.CODE[data], np.array([0, len(text)])
    at = bases.valid_windows(codes, offsets, k)
    if len(at):
        got = bases.sliding_min(bases.nthash(codes, m), k - m + 1)[at].tolist()
        assert got == [minimizer(text[i : i + k], m) for i in at.tolist()]


def test_nthash_vectors():
    for w, h in (("ACGTA", "74bd548097e7d487"), ("TACGT", "74bd548097e7d487"), ("GGCAT", "c4d6ee5570eb5e5b"), ("ACGT", "0" * 16), ("GAATTC", "0" * 16)):
        assert f"{nthash(w):016x}" == h
        assert f"{int(bases.nthash(bases.CODE[np.frombuffer(w.encode(), np.uint8)], len(w))[0]):016x}" == h
        x = 0
        for i, b, v in bases.nthash_constants(len(w)):
            x ^= v if w[i] == b else 0
        assert f"{x:016x}" == h


def test_minimizer_plan_has_one_exchange(reads, spark):
    _, df = reads
    plan = count.count_kmers(spark, df, 21, 11, plan="minimizer")._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("Exchange") == 1


def test_packed_codes(reads):
    r = np.random.default_rng(1)
    codes, n = r.integers(0, 4, 500).astype(np.uint8), np.array([1, 4, 7, 0, 33])
    at = np.array([3, 0, 90, 5, 400])
    packed, ends = bases.pack_all(codes, at, n)
    assert np.diff(ends).tolist() == [1, 1, 2, 0, 9]
    back, offsets = bases.unpack_all(packed, n)
    assert [back[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [codes[a : a + x].tolist() for a, x in zip(at, n)]


def test_tally_merges(reads):
    texts = [dna(400, s, "ACGTN") for s in range(12)] * 2
    for k in (5, 31, 40):
        tally = vector.Tally(k)
        for t in texts:
            tally.add(bases.CODE[np.frombuffer(t.encode(), np.uint8)], np.array([0, len(t)]))
        words, n = tally.counts()
        spelled = ["".join(map(chr, row)) for row in bases.letters(np.stack(words, 1), k)]
        assert dict(zip(spelled, n.tolist())) == brute_count(texts, k)


def first_minimum(w, m):
    hashes = [nthash(w[i : i + m]) for i in range(len(w) - m + 1)]
    return hashes.index(min(hashes))


def test_vertices_and_positions_of_minimizers(spark):
    texts = [dna(150, s, "ACGTN") for s in range(4)] + ["A" * 60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, seq string")
    for k, m in ((9, 4), (21, 11)):
        expected = []
        for i, t in enumerate(texts):
            for p in range(len(t) - k + 1):
                w = t[p : p + k].upper()
                if set(w) <= set("ACGT"):
                    expected.append((i, p, w, min(w, rc(w)), w <= rc(w), f"{minimizer(w, m):016x}", first_minimum(w, m)))
        got = minimizers.vertices(df, k, m, "id").withColumn("minimizer", minimizers.hash_hex("minimizer"))
        assert sorted(map(tuple, got.collect())) == sorted(expected)
        for x in minimizers.superkmers(df, k, m, "id", packed=True, positions=True).withColumn("first", minimizers.first_kmer("sk", k)).collect():
            w = texts[x["id"]][x["pos"] : x["pos"] + k].upper()
            assert (x["min_pos"], x["first"]) == (first_minimum(w, m), w)


def test_integers_of_32_bases_and_codes(spark):
    words = ["A" * 32, "T" * 32, "G" + "A" * 31, "CGTA" * 8]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", seqops.encode("w").alias("v"), seqops.decode(seqops.encode("w"), 32).alias("d")).collect()
    for r in rows:
        value = int("".join(str("ACGT".index(c)) for c in r["w"]), 4)
        assert r["v"] == (value if value < 2**63 else value - 2**64) and r["d"] == r["w"]
    got = spark.createDataFrame([(c, i) for i, c in enumerate("ACGTn-")], "c string, i int").select("c", seqops.code_base("i"), seqops.is_placeholder("c")).collect()
    assert [tuple(r) for r in got] == [("A", "A", False), ("C", "C", False), ("G", "G", False), ("T", "T", False), ("n", "4", True), ("-", "5", True)]


def test_partitions_follow_the_size(spark, tmp_path, monkeypatch):
    spark.range(3000).selectExpr("repeat('ACGT', 50) || id as seq").write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    assert minimizers.default_partitions(df) == 4
    monkeypatch.setattr(minimizers, "PARTITION_BYTES", 1000)
    assert minimizers.default_partitions(df) >= 16


def test_long_runs_are_cut(spark):
    df = spark.createDataFrame([("A" * 2000,)], "seq string")
    rows = minimizers.superkmers(df, 31, 21).orderBy("pos").collect()
    assert [(r["pos"], r["n_bases"]) for r in rows] == [(p, n) for p, n, _ in superkmers("A" * 2000, 31, 21, 255)]


def test_column_functions(spark):
    w = "GATTACA"
    row = spark.createDataFrame([(w, "acgtNx-U", "GATTACAT")], "w string, s string, e string").select(
        seqops.revcomp("w"), seqops.canonical("w"), seqops.encode("w"), seqops.decode(seqops.encode("w"), 7), seqops.pack_hex("w", 7), seqops.base_at("w", 0, 7), seqops.base_at("w", 6, 7), seqops.lmer_at("w", 2, 3), seqops.roll_next("w", F.lit("C")), seqops.roll_prev("w", F.lit("C")), seqops.from_prefix("e"), seqops.from_suffix("e"), seqops.base_reverse("w"), seqops.complement("s"), seqops.mask_of("s"), seqops.mask_of("s", False), seqops.count_non_acgt("s"), seqops.acgt_runs("s"), seqops.in_canonical_form("w"), seqops.same_vertex("w", seqops.revcomp("w")), seqops.front("w"), seqops.back("w"),
    ).first()
    value = int("".join("ACGT".index(c).__str__() for c in w), 4)
    assert list(row) == ["TGTAATC", "GATTACA", value, w, "8F10", "A", "G", "TTA", "ATTACAC", "CGATTAC", w, "ATTACAT", "ACATTAG", "TGCANNNN", "00001111", "00001000", 4, ["ACGT"], True, True, "G", "A"]


def test_lookup_reduce_distinct_packed(reads, spark):
    texts, df = reads
    counts = count.count_kmers(spark, df, 5, 3)
    every = brute_count([t or "" for t in texts], 5)
    got = count.lookup(counts, spark.createDataFrame([("ttttt",), ("CGTAC",)], "kmer string")).collect()
    assert {r["query"]: r["count"] for r in got} == {"ttttt": every["AAAAA"], "CGTAC": every[min("CGTAC", rc("CGTAC"))]}
    assert {r[0] for r in count.distinct_kmers(df, 5).collect()} == set(every)
    assert {bytes(r[0]).hex().upper(): r[1] for r in count.packed(counts, 5).collect()} == {r["h"]: r["count"] for r in counts.select(seqops.pack_hex("kmer", 5).alias("h"), "count").collect()}
    with pytest.raises(ValueError):
        minimizers.partition_of("x", 6)


def test_diagnostics_are_consistent(reads, spark):
    _, df = reads
    covered = minimizers.coverage(df, 11, 5).cache()
    total = covered.agg(F.sum("coverage")).first()[0]
    hist = minimizers.coverage_histogram(covered).collect()
    assert total == minimizers.run_stats(df, 11, 5).first()["kmers"] == sum(r["total_kmers"] for r in hist)
    assert all(r["coverage"] * r["n_minimizers"] == r["total_kmers"] for r in hist)
    parts = minimizers.partition_table(df, 11, 5, 8)
    assert parts.agg(F.sum("n_inserted")).first()[0] == total
    assert minimizers.hot_bins(covered, 3).count() <= 3


def test_stream_counts_as_batch(spark, tmp_path):
    from strandlake.streaming.counts import running_counts

    texts = [dna(120, s) for s in range(6)]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_text(t.replace("\r", "N"))
    stream = spark.readStream.option("maxFilesPerTrigger", 2).text(str(tmp_path)).withColumnRenamed("value", "seq")
    q = running_counts(stream, 7).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert {r["kmer"]: r["count"] for r in spark.table("live").collect()} == brute_count([t.replace("\r", "N") for t in texts], 7)


def test_kmers_leave_in_the_order_of_the_text_with_their_values(spark):
    text = dna(3000, 9, "ACGT") * 2
    tally = vector.Tally(32)
    tally.add(bases.CODE[np.frombuffer(text.encode(), np.uint8)], np.array([0, len(text)]))
    words, n = tally.counts()
    spelled = ["".join(map(chr, row)) for row in bases.letters(words[0][:, None], 32)]
    assert spelled == list(dict.fromkeys(min(w, rc(w)) for w in (text[i : i + 32] for i in range(len(text) - 31))))
    rows = count.count_kmers(spark, spark.createDataFrame([(text,), ("T" * 40,)], "seq string"), 32, 21)
    expected = rows.withColumn("value", seqops.encode("kmer")).withColumn("decoded", seqops.decode("value", 32))
    got = vector.valued(rows, 32)
    assert got.columns == expected.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_superkmers_of_slices(spark, tmp_path, monkeypatch):
    texts = [dna(900, 5), "A" * 3000, "", dna(400, 6, "ACGT")]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = list(minimizers._pieces(data, offsets, 31, 21))
    parts = list(minimizers._pieces(data, offsets, 31, 21, 97))
    for i in range(3):
        assert np.concatenate([p[i] for p in parts]).tolist() == np.concatenate([p[i] for p in whole]).tolist()
    assert max(at[-1] + n[-1] - at[0] for at, n, _ in parts) <= 97 + 30 + 255
    spark.createDataFrame([(dna(3000, i, "ACGT"),) for i in range(20)], "seq string").write.parquet(str(tmp_path / "s"))
    monkeypatch.setattr(minimizers, "PARTITION_BYTES", 1000)
    assert count.count_kmers(spark, spark.read.parquet(str(tmp_path / "s")), 31, 21).rdd.getNumPartitions() >= 16  # shuffle partitions: 4


def test_a_partition_is_counted_bin_by_bin(reads, spark):
    texts, df = reads
    counts = count.count_kmers(spark, df, 21, 11, plan="minimizer", partitions=1)
    assert "Sort [pid" in counts._jdf.queryExecution().optimizedPlan().toString()
    assert counts.rdd.getNumPartitions() == 1 and count.collect_dict(counts) == brute_count([t or "" for t in texts], 21)


@pytest.mark.parametrize("alike", (False, True))
def test_gathered_rows(monkeypatch, alike):
    if alike:  # mixed bits that tell nothing
        monkeypatch.setattr(vector, "_MIX", np.zeros(3, np.uint64))
    r = np.random.default_rng(2)
    for width in (1, 2, 3):
        words, n = [r.integers(0, 5, 400).astype(np.uint64) << np.uint64(60) for _ in range(width)], r.integers(1, 9, 400)
        rows, sums = vector.gathered(words, n)
        expected = {}
        for row, x in zip(zip(*(w.tolist() for w in words)), n.tolist()):
            expected[row] = expected.get(row, 0) + x
        assert list(zip(zip(*(w.tolist() for w in rows)), sums.tolist())) == list(expected.items())


def test_partitions_follow_the_size_of_files(spark, tmp_path, monkeypatch):
    texts = [dna(2000, i, "ACGT") for i in range(5)]
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress("".join(f">{i}\n{t}\n" for i, t in enumerate(texts)).encode()))
    monkeypatch.setattr(minimizers, "PARTITION_BYTES", 500)
    counts = count.count_kmers(spark, str(tmp_path / "a.fa.gz"), 9, 5, plan="minimizer")
    assert counts.rdd.getNumPartitions() >= 16  # shuffle partitions: 4
    assert count.collect_dict(counts) == brute_count(texts, 9)


def test_coverage_is_summed_by_slices(reads, spark):
    _, df = reads
    covered = minimizers.coverage(df, 21, 5)
    assert "n_bases" not in covered._jdf.queryExecution().optimizedPlan().toString()
    expected = {}
    for r in minimizers.superkmers(df, 21, 5).collect():
        expected[r["minimizer"]] = expected.get(r["minimizer"], 0) + r["n_bases"] - 20
    assert {r["minimizer"]: r["coverage"] for r in covered.collect()} == expected


def test_letters_are_counted_by_batches(spark):
    texts = ["Naïve ÅB{}[]@`", "", None, "aAzZ" * 300, "日本x\n"]
    got = vector.letter_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "text").collect()
    assert dict(map(tuple, got)) == Counter(c for t in texts for c in t or "" if c.isascii() and c.isalpha())
