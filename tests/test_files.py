import gzip

import pytest
from brute import count as brute_count

from strandlake import cli
from strandlake.operators import count
from strandlake.sources import fastx, sinks

CASES = {
    "basic": (">s1\nACGTAC\n", 3, 1, {"ACG": 2, "GTA": 2}),
    "multiline": (">s1\nACG\nTAC\n", 3, 1, {"ACG": 2, "GTA": 2}),
    "lower": (">s1\nacgTAC\n", 3, 1, {"ACG": 2, "GTA": 2}),
    "split_n": (">s1\nACGNTAC\n", 3, 2, {"ACG": 1, "GTA": 1}),
    "iupac": (">s1\nACGRU-TAC\n", 3, 2, {"ACG": 1, "GTA": 1}),
    "crlf": (">s1\r\nACG\r\nTAC\r\n", 4, 2, {}),
    "two": (">s1\nACG\n>s2\nTAC\n", 4, 2, {}),
    "midline": (">s1\nACGT>x\nTACG\n", 4, 2, {"ACGT": 1, "CGTA": 1}),
    "gt_in_header": (">s1 a>b\nACGTAC\n", 3, 1, {"ACG": 2, "GTA": 2}),
    "before": ("ACGTACGT\n>s1\nAAAA\n", 3, 1, {"AAA": 2}),
    "no_header": ("ACGTACGT\n", 3, 0, {}),
    "short": (">s1\nACNGTNA\n", 3, 3, {}),
    "no_newline": (">s1\nACGTAC", 3, 1, {"ACG": 2, "GTA": 2}),
    "palindrome": (">s1\nACGTACGT\n", 4, 1, {"ACGT": 2, "CGTA": 2, "GTAC": 1}),
    "strand": (">a\nAACCGG\n>b\nCCGGTT\n", 3, 2, {"AAC": 2, "ACC": 2, "CCG": 4}),
    "poly": (">s1\nAAAAAAA\n", 3, 1, {"AAA": 5}),
    "fastq": ("@r1\nACGTAC\n+\nIIIIII\n@r2\nACNGTA\n+\n@@@@@@\n", 3, 3, {"ACG": 2, "GTA": 3}),
    "headers": (">s1\n>s2\n\n", 3, 0, {}),
    "blank": (">s1\nACG\n\n\nTAC\n", 4, 1, {"ACGT": 1, "CGTA": 1, "GTAC": 1}),
}


@pytest.mark.parametrize("name", CASES)
def test_edge_files(spark, tmp_path, name):
    text, k, seqs, expected = CASES[name]
    plain, packed = tmp_path / "a.fx", tmp_path / "a.fx.gz"
    plain.write_bytes(text.encode())
    packed.write_bytes(gzip.compress(text.encode()))
    df = fastx.read(spark, str(plain))
    assert count.run_stats(df, k).first()["seqs"] == seqs
    assert count.collect_dict(count.count_kmers(spark, df, k, 1)) == expected
    if name in ("basic", "fastq"):
        both = count.count_kmers(spark, [str(plain), str(packed)], k, 1)
        assert count.collect_dict(both) == {w: 2 * n for w, n in expected.items()}


def test_columns(spark, tmp_path):
    (tmp_path / "q.fastq").write_text("@r1 x\nAC\n+\nI@\n@r2\nGG\n+\n>>\n")
    rows = fastx.read(spark, str(tmp_path / "q.fastq")).orderBy("record_id").collect()
    assert [(r["header"], r["seq"], r["quality"]) for r in rows] == [("r1 x", "AC", "I@"), ("r2", "GG", ">>")]


def test_crlf_can_be_stripped(spark, tmp_path):
    (tmp_path / "c.fa").write_bytes(b">s1\r\nACG\r\nTAC\r\n")
    df = fastx.read(spark, str(tmp_path / "c.fa"), keep_carriage_returns=False)
    assert df.first()["seq"] == "ACGTAC"


def test_bad_files(spark, tmp_path):
    (tmp_path / "e.fa").write_bytes(b"")
    (tmp_path / "e.fa.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "t.fa.gz").write_bytes(gzip.compress(b">s\n" + b"ACGT" * 5000)[:-12])
    for name in ("e.fa", "e.fa.gz", "t.fa.gz"):
        with pytest.raises(Exception):
            fastx.read(spark, str(tmp_path / name)).count()
    with pytest.raises(FileNotFoundError):
        fastx.read(spark, str(tmp_path / "missing.fa"))


def test_ranges_of_a_file_hold_each_record_once(tmp_path):
    import random

    r, text = random.Random(5), ""
    for i in range(60):
        text += f">s{i} a>b\n" + "".join("\n" if r.random() < 0.1 else ">" + "h\n" if r.random() < 0.01 else r.choice("ACGT") for _ in range(r.randrange(40))) + "\n"
    path = tmp_path / "r.fa"
    path.write_text(text)
    with open(path, "rb") as f:
        whole = list(fastx.fasta_records(f))
        for step in (1, 7, 50, 333):
            cut = [x for a in range(0, len(text), step) for x in fastx.fasta_records(f, a, min(a + step, len(text)))]
            assert cut == whole


def test_ranges_of_a_fastq_file_hold_each_record_once(tmp_path):
    import random

    r, text = random.Random(6), ""
    for i in range(60):
        n = r.randrange(30)
        text += f"@s{i} +x\n" + "".join(r.choice("ACGTN") for _ in range(n)) + "\n+" + r.choice(["", f"s{i}"]) + "\n" + "".join(r.choice("@+IJ>") for _ in range(n)) + "\n"
    path = tmp_path / "r.fq"
    for content in (text, text[:-1]):
        path.write_text(content)
        with open(path, "rb") as f:
            whole = list(fastx.fastq_records(f))
            assert len(whole) == 60
            for step in (1, 7, 50, 333):
                assert [x for a in range(0, len(content), step) for x in fastx.fastq_records(f, a, min(a + step, len(content)))] == whole


def test_columns_and_non_bases_can_be_chosen(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGNN\nTAC\n>two\nNNN\n>three\nggA\n")
    (tmp_path / "b.fq").write_text("@q\nACNGT\n+\nIIIII\n")
    folder = f"file://{tmp_path}"
    rows = lambda **more: sorted(map(tuple, fastx.read(spark, folder, **more).collect()), key=str)
    assert rows(columns=("seq",)) == sorted([("ACGNNTAC",), ("NNN",), ("ggA",), ("ACNGT",)], key=str)
    assert rows(columns=("header", "seq"), non_bases="split") == sorted([("one x", "ACG"), ("one x", "TAC"), ("three", "ggA"), ("q", "AC"), ("q", "GT")], key=str)
    assert rows(columns=("seq", "record_id"), non_bases="skip") == sorted([("ACGTAC", 0), ("", 1), ("ggA", 2), ("ACGT", 0)], key=str)
    assert rows(columns=("quality",)) == sorted([(None,), (None,), (None,), ("IIIII",)], key=str)
    for bad in ({"columns": ()}, {"columns": ("text",)}, {"non_bases": "x"}):
        with pytest.raises(ValueError):
            fastx.read(spark, folder, **bad)


def test_one_record_is_spread_over_the_cores(spark, tmp_path):
    import random

    text = "".join(random.Random(1).choice("ACGTN"[: 4 + (i % 50 == 0)]) for i in range(5000))
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(f">s\n{text}\n".encode()))
    df = count.spread(fastx.read(spark, str(tmp_path / "a.fa.gz")), 7, part=300)
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() > 10
    assert count.collect_dict(count.count_kmers(spark, df, 7)) == dict(brute_count([text], 7)) == count.collect_dict(count.count_kmers(spark, str(tmp_path / "a.fa.gz"), 7))


def test_callback(spark, tmp_path):
    folder = str(tmp_path)

    def note(kmer, n):
        with open(f"{folder}/{kmer if isinstance(kmer, str) else bytes(kmer).hex()}", "w") as f:
            f.write(str(n))

    counts = count.count_kmers(spark, spark.createDataFrame([("ACGTAC",)], "seq string"), 3)
    count.for_each(counts, note)
    assert {f.name: f.read_text() for f in tmp_path.iterdir()} == {"ACG": "2", "GTA": "2"}
    count.for_each(counts, note, binary=3)
    assert (tmp_path / "18").read_text() == "2"


def test_list_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s\nACGTAC\n")
    (tmp_path / "list").write_text(f"\n{tmp_path}/a.fa\n\n{tmp_path}/a.fa\n")
    assert fastx.expand(f"@{tmp_path}/list") == [f"{tmp_path}/a.fa"] * 2
    assert count.collect_dict(count.count_kmers(spark, f"@{tmp_path}/list", 3, 1)) == {"ACG": 4, "GTA": 4}


@pytest.mark.parametrize("k", (4, 7, 31))
def test_sinks(spark, tmp_path, k):
    texts = ["ACGTTGCA" * 9, "GATTACAGATTACACATTAG" * 4]
    counts = count.count_kmers(spark, spark.createDataFrame([(t,) for t in texts], "seq string"), k, 3)
    expected = dict(brute_count(texts, k))
    for align in ("left", "right"):
        sinks.write_kff(counts, str(tmp_path / "o.kff"), k, align)
        assert count.collect_dict(sinks.read_kff(spark, str(tmp_path / "o.kff"), align)) == expected
    sinks.write_kff(counts.repartition(3), str(tmp_path / "many"), k, single=False)
    files = sorted((tmp_path / "many").iterdir())
    assert len(files) == 3 and all(f.suffix == ".kff" for f in files)
    assert {w: n for f in files for w, n in count.collect_dict(sinks.read_kff(spark, f"file://{f}")).items()} == expected
    assert [f.name for f in tmp_path.iterdir() if "parts" in f.name] == []
    sinks.write_counts(counts, str(tmp_path / "o.tsv"))
    assert {x.split("\t")[0]: int(x.split("\t")[1]) for x in (tmp_path / "o.tsv").read_text().splitlines()} == expected
    sinks.write_counts(counts, str(tmp_path / "o.parquet"))
    assert count.collect_dict(spark.read.parquet(str(tmp_path / "o.parquet"))) == expected
    sinks.write_counts(counts.limit(0), str(tmp_path / "empty.kff"), k)
    assert count.collect_dict(sinks.read_kff(spark, str(tmp_path / "empty.kff"))) == {}
    cut = (tmp_path / "o.kff").read_bytes()
    (tmp_path / "cut.kff").write_bytes(cut[:-20])
    with pytest.raises(Exception):
        sinks.read_kff(spark, str(tmp_path / "cut.kff")).count()
    with pytest.raises(Exception):
        sinks.write_kff(counts.selectExpr("kmer", "count + 4294967296 as count"), str(tmp_path / "big.kff"), k)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(">s\nACGTACNAC\n")
    assert cli.main(["-k", "3", "-m", "1", "-ci", "2", "-dbg", "-kff", str(tmp_path / "a.fa"), str(tmp_path / "out")], spark) == 0
    assert count.collect_dict(sinks.read_kff(spark, str(tmp_path / "out.kff"))) == {"ACG": 2, "GTA": 2}
    said = capsys.readouterr().err
    for key in ("seqs: 2", "kmers: 4", "superkmers: ", "phase1: ", "n_parts: ", "phase2: ", "unique_kmers: 2", "dbg_n_minimizers: "):
        assert key in said
    assert cli.main(["-k", "3", "-m", "1", "-tp", str(tmp_path / "a.fa")], spark) == 0
    said = capsys.readouterr().err
    assert "seqs: 2" in said and "kmers: 4" in said and "superkmers: " in said and "phase2" not in said
    for bad in (["-k", "1"], ["-m", "40"], ["-k", "9", "-m", "9"], ["-t", "0"]):
        with pytest.raises(SystemExit):
            cli.main([*bad, "a", "b"], spark)
