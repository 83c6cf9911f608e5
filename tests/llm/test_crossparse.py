import math
import random

import numpy as np
import pytest
from test_ops import KIND, ROWS, prose

from strandlake.llm import crossparse

NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND).repartition(5).cache()


def brute_phrases(text, references):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and any(text[i : j + 1] in r for r in references):
            j += 1
        n, i = n + 1, j
    return n


def brute_own(text):
    seen, n, now = set(), 0, ""
    for c in text:
        now += c
        if now not in seen:
            seen.add(now)
            n, now = n + 1, ""
    return n + (now != "")


def test_parsing_by_automaton_is_greedy():
    r = random.Random(3)
    for _ in range(150):
        reference, text = ("".join(r.choice("abc") for _ in range(r.randrange(60))) for _ in range(2))
        text += r.choice(["", "z", "zz", "☃a"])
        assert crossparse.cross_phrases(text, crossparse.automaton(reference)) == brute_phrases(text, [reference])
        assert crossparse.own_phrases(text) == brute_own(text)


def test_suffixes_are_sorted():
    r = random.Random(4)
    for bits, n in [(1, 200), (2, 300), (7, 50), (17, 40), (2, 1), (1, 2)]:
        for repeated in (1, 3):
            text = [r.randrange(1 << bits) for _ in range(n)] * repeated
            made = crossparse.Suffixes(np.array(text, np.int64), bits)
            expected = sorted(range(len(text)), key=lambda i: text[i:])
            real = [i for i in expected if any(text[i:])]  # suffixes of zeros only are equal but for their length
            assert [i for i in made.order.tolist() if any(text[i:])] == real
            for rank in range(1, len(text)):
                a, b = text[made.order[rank - 1] :], text[made.order[rank] :]
                common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), None)
                assert common is None or made.common[rank] == common


def test_blocks_against_brute_force():
    r = random.Random(5)
    for t in range(120):
        texts = ["".join(r.choice("ab" if t % 2 else "abcdé☃\0") for _ in range(r.randrange(60))) for _ in range(r.randrange(1, 8))]
        texts += [texts[0], ""] * (t % 3)
        owners = [r.randrange(5) for _ in texts]
        for text, own, got in zip(texts, owners, crossparse.parsed(texts, owners, [NONE] * len(texts))):
            others = [x for x, o in zip(texts, owners) if o != own]
            assert got == (brute_phrases(text, others), 0, sum(map(len, others)))
            # the sorted form finds what the automaton finds
            assert got[0] == crossparse.cross_phrases(text, crossparse.automaton("\x01".join(others)))


def test_stretches_of_the_corpus_count_as_one_phrase():
    text = "abcdefghij" * 3
    got = crossparse.parsed([text, "b"], [1, 2], [(np.array([10]), np.array([25])), NONE])
    assert got[0] == (10 + 5, 1, 1)
    # adjacent pieces of one link are joined, others are not
    places = np.array([0 << 17 | 30, 30 << 17 | 40, 70 << 17 | 50, 130 << 17 | 26], np.int64)
    starts, stops = crossparse.stretches(places, np.array([7, 7, 8, 8], np.int64))
    assert starts.tolist() == [0, 70, 130] and stops.tolist() == [70, 120, 156]
    assert [x.tolist() for x in crossparse.stretches(places[:0], places[:0])] == [[], []]


def test_pieces_tile_texts_and_agree_in_equal_passages():
    passage = prose(300, 1)
    texts = ["", prose(100, 2) + passage + prose(50, 3), passage, "x" * 5000, "abc", prose(7, 4) + passage]
    number, start, size, key = crossparse.pieces(texts)
    for i, text in enumerate(texts):
        own = np.flatnonzero(number == i)
        assert "".join(text[start[j] : start[j] + size[j]] for j in own) == text
        assert all(size[own[1:-1]] > crossparse.GAP)
    inside = {int(k) for k, i in zip(key, number) if i == 2}
    assert len(inside) > 20
    for i in (1, 5):
        assert len(inside & {int(k) for k, j in zip(key, number) if j == i}) >= len(inside) - 3


def expected_rows(rows):
    """Brute force over a table that fits one block; rows of one id and text are one document."""
    rows = [(i, t or "") for i, t in rows]
    out = []
    for i, text in rows:
        others = [t for j, t in set(rows) if (j, t) != (i, text)]
        n, c, own = len(text), brute_phrases(text, others), brute_own(text)
        reference = sum(map(len, others))
        out.append((i, n, c, own, reference, round((c * math.log2(max(reference, n) + 1) - own * math.log2(max(own, 1))) / n, 9) if n else 0.0))
    return sorted(out, key=str)


def test_scored_against_brute_force(spark):
    r = random.Random(6)
    rows = [(i, prose(r.randrange(5, 60), i)) for i in range(25)] + [(30, None), (31, ""), (None, prose(20, 3)), (None, "abc"), (3, prose(4, 9)), (40, "日本語 ☃"), (41, prose(12, 5))]
    rows += [rows[4]] * 3 + [(50, rows[4][1])]
    got = crossparse.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted([(x["doc_id"], x["n_chars"], x["cross_phrases"], x["own_phrases"], x["reference_chars"], round(x["score"], 9)) for x in got], key=str) == expected_rows(rows)
    assert {x["corpus_chars"] for x in got} == {sum(len(t or "") for _, t in rows)}


def test_scores(docs, spark):
    rows = crossparse.scored(docs, block=50_000).collect()
    assert len(rows) == len(ROWS)
    assert all(x["score"] == 0 and x["z_score"] is None for x in rows if not x["n_chars"])
    again = crossparse.scored(docs.repartition(2), block=50_000).collect()
    plain = lambda rows: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in rows], key=str)
    assert plain(again) == plain(rows)
    assert crossparse.scored(spark.createDataFrame([], KIND)).count() == 0
    alone = crossparse.scored(spark.createDataFrame([(1, "abcabc")], "doc_id long, text string")).collect()
    assert [(x["cross_phrases"], x["reference_chars"]) for x in alone] == [(6, 0)]
    mixed = [(i, prose(100, i)) for i in range(200)] + [(1000 + i, "".join(random.Random(i).choice("XYZ#%$") for _ in range(400))) for i in range(4)]
    got = crossparse.scored(spark.createDataFrame(mixed, "doc_id long, text string"), block=30_000).collect()
    assert min(x["score"] for x in got if x["doc_id"] >= 1000) > max(x["score"] for x in got if x["doc_id"] < 1000)


def test_copies_are_found_in_the_whole_corpus(spark):
    """Blocks so small that a copy is hardly ever in the same one; hot pieces by broadcast and others by their hash."""
    rows = [(i, prose(300, 5000 + i)) for i in range(60)]
    passage = rows[1][1][500:1500]
    rows += [(100, rows[0][1]), (101, prose(100, 1) + passage + prose(100, 2)), (None, rows[2][1]), (3, rows[3][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for hot in (False, True):
        with pytest.MonkeyPatch.context() as patch:
            if hot:  # all pieces of two or more rows
                patch.setattr(crossparse, "SAMPLE", 1)
                patch.setattr(crossparse, "HOT_ROWS", 1)
                patch.setattr(crossparse, "HOT", 10**9)
                keyed = table.selectExpr("xxhash64(doc_id, text) as doc", "doc_id", "text")
                assert crossparse._hot(keyed, 1).count() > 50
            found.append(crossparse.scored(table, block=2_000).collect())
    assert sorted(map(str, found[0])) == sorted(map(str, found[1]))
    ratio = {}
    for x in found[0]:
        ratio.setdefault(x["doc_id"], []).append((x["cross_phrases"] / x["n_chars"], x["score"]))
    plain = min(x for i in range(4, 60) for x in ratio[i])
    assert all(max(ratio[i])[0] < 0.03 for i in (0, 100, 2, None))
    assert max(ratio[1])[0] < 0.75 * plain[0] and max(ratio[101])[0] < 0.75 * plain[0]
    assert len(ratio[3]) == 2 and min(ratio[3])[0] >= 0.9 * plain[0]  # a repeated row is no other document


def test_long_texts_are_parsed_in_segments(spark):
    long = prose(40_000, 7)
    rows = [(1, long), (2, long[70_000:]), (3, "short")]
    got = {x["doc_id"]: x for x in crossparse.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_chars"] == len(long) and got[2]["n_chars"] == len(long) - 70_000
    assert got[2]["cross_phrases"] <= 2 * (len(long) // crossparse.SEGMENT + 2)


def test_against_a_given_text(docs, spark):
    reference = prose(200, 11)
    got = crossparse.against(docs, reference).collect()
    assert len(got) == len(ROWS)
    for x in got:
        text = next(t or "" for i, t, *_ in ROWS if i == x["doc_id"] and len(t or "") == x["n_chars"])
        if len(text) < 1000:
            assert x["cross_phrases"] == brute_phrases(text, [reference]) and x["own_phrases"] == brute_own(text)
    with pytest.raises(ValueError):
        crossparse.against(docs, "x" * (crossparse.REFERENCE + 1))
    assert crossparse.against(spark.createDataFrame([], KIND), "").count() == 0
