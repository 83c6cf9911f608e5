import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from strandlake.llm.common import Workspace, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_chat_format", "op6_sharding", "op7_minhash", "op8_decontaminate"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, expected = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[expected.columns.index(c)] for c in columns)) for r in expected.fetchall())


def test_stages_one_by_one(spark):
    from test_ops import brute_components, brute_hits

    work = Workspace(spark)
    docs = table(spark, SF, "documents")
    items = [(str(r["item_id"]), r["text"]) for r in table(spark, SF, "benchmark").collect()]
    quality = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = work.save(stage(spark, docs, SF), name)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "packing":
            assert after.columns == docs.columns
            left = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "quality":
            assert {i for i in before if quality.get(i) == 0} & set(left) == set()
            assert all(i in left for i in before if quality.get(i) == 1)
        elif name == "language":
            assert left == before
        elif name == "near_dedup":
            assert set(left) == {d for d, _, c in brute_components(sorted(before.items()), 5) if d == c}
        elif name == "decontaminate":
            hits = {i: brute_hits(t, items) for i, t in before.items()}
            assert set(left) == {i for i, (n, hit, _) in hits.items() if not hit or 20 * len(hit) < n}
            assert all(left[i] == before[i] for i in left if not hits[i][1])
            assert any(hit for _, hit, _ in hits.values())
        else:
            pieces = after.groupBy("doc_id").sum("length").join(after.select("doc_id", "doc_tokens").distinct(), "doc_id").collect()
            assert {r[0] for r in pieces} == set(before) and all(r[1] == r[2] for r in pieces)
        docs = after


def test_language_stage_keeps_all_where_no_language_is_known(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "other text", None)], "doc_id long, text string, lang string")
    assert corpus_pipeline.language_filter(spark, docs, SF).count() == 2


def test_near_dedup_decides_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(5, a), (1, a), (5, b), (None, c), (None, c), (7, d), (7, d), (None, b), (9, ""), (9, ""), (9, None), (10, " ")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), SF).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, a), (5, b), (None, c), (7, d), (9, ""), (9, None), (10, " ")]))


CLASHING = "doc_id long, text string, lang string, score double, score_ double, lang_pred string, lang_pred_ string, gone_ long, row long, row_ long, m0 string, c1 string, id long, g string, n_chars long"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.0, 0.0, "l", "p", 1, 2, 3, "m", "c", 4, "g", len(t or "")) for i, t, lang in rows], CLASHING)


def test_stages_carry_columns_of_any_name_and_take_all_cases(spark):
    """Null, empty and long texts, repeated rows and ids, no id, columns named like the operators' own, no rows at all."""
    text, other, third = ("".join(f"{w}{i} of the book, " for i in range(40)) for w in ("word", "leaf", "noun"))
    rows = [(1, text, "en"), (1, other, "en"), (2, text, "en"), (2, third, None), (None, text, "en"), (None, text, "en"), (3, None, "en"), (4, "", None), (5, (other[:300] + " x ") * 400, "en")]
    docs, none = clashing(spark, rows), clashing(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        got, empty = stage(spark, docs, SF), stage(spark, none, SF)
        assert empty.count() == 0
        if name == "packing":
            assert got.groupBy("doc_id").count().count() == 6
            continue
        assert got.columns == docs.columns and empty.columns == docs.columns
        left = [(r["doc_id"], r["text"]) for r in got.collect()]
        assert all(r["gone_"] == 1 and r["g"] == "g" and r["c1"] == "c" and r["m0"] == "m" for r in got.collect())
        if name == "language":
            assert sorted(left, key=str) == sorted([r[:2] for r in rows if r[1]], key=str)
        elif name == "near_dedup":
            assert sorted(left, key=str) == sorted([(1, text), (1, other), (2, third), (3, None), (4, ""), rows[8][:2]], key=str)
        elif name == "decontaminate":
            assert sorted(left, key=str) == sorted([r[:2] for r in rows], key=str)
        else:
            assert set(left) <= {r[:2] for r in rows}


def test_workspaces_are_cleared(spark):
    import os

    with Workspace.scope():
        work = Workspace(spark)
        first = work.save(spark.range(3), "a")
        path = work.path.removeprefix("file://")
        old = work.last.removeprefix("file://")
        assert first.count() == 3 and os.path.exists(old)
        work.save(spark.range(4), "b", instead=work.last)
        assert not os.path.exists(old) and os.path.exists(path)
    assert not os.path.exists(path)


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "decontaminate", "packing"]
    assert entry.queries()["pipeline"](spark, SF).count() > 0
