"""Each operator against brute force on small tables with nulls, empty and long texts, ties,
repeated rows and columns whose names clash with those the operator makes; and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import chat, decontaminate, editwalk, language, neardup, packing, quality, sharding, urls

R = random.Random(8)
VOCABULARY = ["".join(R.choice("abcdefghéüñ") for _ in range(R.randrange(2, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, n, seed):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(VOCABULARY)
    return " ".join(words)


BASE = [prose(120, i) for i in range(6)]
TEXTS = [None, "", " \t\n ", "one two", "ONE two", "one two three four", *BASE, *[edited(b, n, n) for b in BASE[:4] for n in (1, 2, 3, 5, 8, 20)], BASE[0].upper(), BASE[1], BASE[1], prose(20_000, 99), "x" * 30_000, "a  b\tc \n d", "!!! 123 ???", "日本語 テキスト 日本語"]
#: (doc_id, text, lang, source, n_chars) and columns that operators use as names of their own
KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, c0 string, spans string"
ROWS = [(i, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or ""), 0.5, "x", "y", "z") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[7], ROWS[7], (8, "another text of one id", "en", "s0", 22, None, None, None, None), (None, "no id at all", "fr", "s9", 12, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


# 7 near-duplicates


def shingles(text, k):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return [(d, len(sets[i]), min(least[root(i)]) if sets[i] and least[root(i)] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("k", (4, 5))
def test_near_duplicates(docs, empty, k):
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, k).collect())))
    assert got == sorted(map(str, brute_components([(r[0], r[1]) for r in ROWS], k)))
    assert neardup.near_duplicates(empty, k).count() == 0


def test_blocks_of_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rows = [(i, edited(prose(60, 5), i % 4, i)) for i in range(40)] + [(50 + i, prose(30, 100 + i)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 4).collect())
    assert got == sorted(brute_components(rows, 4))


def test_rows_without_id_and_of_one_id_are_linked_by_their_texts(spark):
    a, b = prose(80, 60), prose(80, 61)
    rows = [(None, a), (None, edited(a, 1, 1)), (7, edited(a, 1, 2)), (None, b), (5, edited(b, 1, 3)), (5, a), (5, "else " + prose(40, 62))]
    got = [(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()]
    # the texts near a have 5, 7 and none as ids, those near b 5 and none
    assert sorted(got, key=str) == sorted([(None, 5), (None, 5), (7, 5), (None, 5), (5, 5), (5, 5), (5, 5)], key=str)


def test_tables_of_texts_without_words(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (3, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == sorted((str(i), 0, str(i), True) for i, _ in rows)
    assert editwalk.near_by_edits(df.where("text is null or text = ''")).count() == 4


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    for n, common in ((3, 2), (40, 30), (1000, 800), (5000, 1000)):
        agree = []
        for _ in range(12):
            x = r.integers(0, 2**63, 2 * n - common).astype(np.uint64)
            a, b = neardup.sketches([np.sort(x[:n]), np.sort(x[n - common :])])
            agree.append((a == b).mean())
        assert abs(np.mean(agree) - common / (2 * n - common)) < 0.05
    assert (neardup.sketches([np.array([5], np.uint64)]) < 2**64 - 1).all()


# 1 packing


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(packing.byte_bpe_files()[0])
    expected = defaultdict(int)
    ids = {}
    for r in ROWS:
        own = np.array([*tokens.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(own), 2048):
            piece = own[at : at + 2048]
            expected[(r[0], at, len(piece), zlib.crc32(piece.tobytes()), len(own))] += 1
        ids[r[0]] = own
    rows = packing.pack(docs).collect()
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[tuple(r)[:5]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == expected
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 2  # remainders are not cut again
    assert packing.pack(empty).count() == 0


def test_fill_is_optimal():
    r = random.Random(2)
    for _ in range(60):
        room = r.randrange(1, 60)
        counts = {r.randrange(1, 40): r.randrange(1, 4) for _ in range(r.randrange(6))}
        sums = {0}
        for x, n in counts.items():
            sums = {s + i * x for s in sums for i in range(n + 1)}
        used = packing.fill(counts, room)
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[x] for x, n in used.items())


def test_plan_uses_everything():
    counts = {1: 10_000_000, 700: 3_000_000, 1500: 999_999, 2047: 5}
    total = defaultdict(int)
    for used, times in (patterns := packing.plan(dict(counts))):
        assert sum(x * n for x, n in used.items()) <= 2048
        for x, n in used.items():
            total[x] += n * times
    assert total == counts and len(patterns) < 100


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    encode, tokens = packing.encoder(*packing.byte_bpe_files()), Tokenizer.from_file(packing.byte_bpe_files()[0])
    r = random.Random(4)
    texts = ["".join(r.choice("ab  \n\t\u00a0\x1c'sé1!日") for _ in range(r.randrange(40))) for _ in range(800)] + ["a <|endoftext|> b", "it's  we'll", " lead", "trail ", "x\u2003 y"]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokens.encode(t, add_special_tokens=False).ids, t


# 2 language


def test_language(docs, empty, spark):
    r = random.Random(1)
    sounds = {"aa": "abcde", "bb": "defgh", "cc": "stuvw"}
    rows = [(i, " ".join("".join(r.choice(sounds[lang]) for _ in range(5)) for _ in range(60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id < 120"))
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows)
    found = language.predict(docs, model)
    assert found.columns == [*docs.columns, "lang_pred", "score", "coverage"] and found.count() == len(ROWS)
    kinds = {r[1]: (r[9], r[10]) for r in found.collect()}
    assert kinds[None] == kinds[""] == kinds["!!! 123 ???"] == ("und", 0.0)
    assert kinds["日本語 テキスト 日本語"][0] == "aa"
    assert language.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(empty)).collect()} == {"und"}


def test_more_than_256_languages(spark):
    rows = [(i, "".join(chr(0x4E00 + 8 * i + j) for j in range(8)) * 4, f"l{i:03}") for i in range(270)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r["lang"] == r["lang_pred"] for r in language.predict(df, language.fit(df)).collect())


def test_bit_slices_equal_filters_of_each_language():
    r = np.random.default_rng(3)
    members = [r.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(11)]
    table = np.zeros((2, 1 << 20), np.uint8)
    model = language.Filter([str(i) for i in range(11)], table)
    for i, own in enumerate(members):
        for at in model._places(own):
            table[i // 8, at] |= np.uint8(1 << i % 8)
    model = language.Filter([str(i) for i in range(11)], table)
    asked = np.concatenate([members[3], members[9], r.integers(0, 2**63, 4000).astype(np.uint64)])
    owner = np.repeat([0, 1, 2], [3000, 3000, 4000])
    total, hits = model.hits(asked, owner, 3)
    assert hits[0, 3] == 3000 and hits[1, 9] == 3000 and total.tolist() == [3000, 3000, 4000]
    assert np.abs(hits[2] / 4000 - model.chance).max() < 0.01


def brute_grams(text):
    """The n-grams of a text as strings: letters lower-cased, one blank after each word that something follows; word starts are marked."""
    low, out = "", []
    for c in text:
        if c.isalpha():
            low += c.lower() if len(c.lower()) == 1 else c
        elif low and low[-1] != " ":
            low += " "
    for i, c in enumerate(low):
        if c != " ":
            if i == 0 or low[i - 1] == " ":
                out.append("^" + c)
            out += [low[i : i + n] for n in (2, 3, 4) if i + n <= len(low)]
    return out


def test_grams_by_brute_force():
    texts = ["", "ab", "cd", "  Hello,  World! ", "ÀÉ ß\U00030000\U00030001x", "İx 12", "日本語 テキスト", prose(50, 3)]
    data, offsets = language.string_buffers(language.pa.array(texts))
    hashes, owner, letters = language.grams(data, offsets)
    names = {}
    for i, t in enumerate(texts):
        assert letters[i] == sum(c.isalpha() for c in t)
        own, expected = hashes[owner == i].tolist(), brute_grams(t)
        alone = language.grams(*language.string_buffers(language.pa.array([t])))[0]
        assert sorted(own) == sorted(alone.tolist()) and len(own) == len(expected)
        count = lambda x: sorted(x.count(v) for v in set(x))
        assert count(own) == count(expected)
        names[i] = set(own), set(expected)
    for i in names:  # one hash for each n-gram in all texts
        for j in names:
            assert len(names[i][0] & names[j][0]) == len(names[i][1] & names[j][1])


def test_languages_by_brute_force(spark):
    """Fit and prediction against sets of strings: the filter has no n-gram less, and chance adds few."""
    r = random.Random(12)
    alike = {"aa": "abcdefg", "bb": "abcdexy", "cc": "defgxyz"}
    rows = [(i, " ".join("".join(r.choice(alike[lang]) for _ in range(r.randrange(2, 6))) for _ in range(r.randrange(1, 40))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(500, rows[0][1], None), (501, "", "aa"), (502, None, "bb"), (503, "1 2 3", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {lang: defaultdict(int) for lang in alike}
    for i, t, lang in set(rows):
        for g in brute_grams(t or "") if lang else ():
            counts[lang][g] += 1
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    members = {lang: {g for g, n in c.items() if n / total[lang] >= language.SHARE * max(counts[x][g] / total[x] if g in counts[x] else 0 for x in counts)} for lang, c in counts.items()}
    model = language.fit(df.union(df))  # repeated rows count once
    assert model.languages == sorted(alike)
    for x in language.predict(df, model).collect():
        own = brute_grams(x["text"] or "")
        if not any(c.isalpha() for c in x["text"] or ""):
            assert (x["lang_pred"], x["score"], x["coverage"]) == ("und", 0.0, 0.0)
            continue
        share = {lang: sum(g in members[lang] for g in own) / len(own) for lang in sorted(alike)}
        best = max(share.values())
        assert abs(share[x["lang_pred"]] - best) < 0.02 and abs(x["coverage"] - best) < 0.02
        assert abs(x["score"] - best / sum(share.values())) < 0.02


def test_filter_is_bounded():
    for languages, most in [(1, 10), (8, 10**6), (300, 10**6), (7000, 10**7), (9, 0)]:
        size = language.places_for(languages, most)
        assert size & (size - 1) == 0 and -(-languages // 8) * size <= language.TABLE_BYTES
    assert language.places_for(4, 50_000) == 1 << 20 and language.places_for(4, 10**6) == 1 << 24


def test_language_holds_little_of_a_long_text():
    """A text of 4 MB and 4 MB of texts: counting and predicting hold the n-grams of a part, and give what the whole gives."""
    import tracemalloc

    pa, texts = language.pa, [prose(800_000, 5), *[prose(500, i) for i in range(1600)]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["aa", "bb"] * 800 + ["aa"])], ["text", "lang"])
    hashes, owner, _ = language.grams(*language.string_buffers(batch.column("text")))
    table = np.zeros((1, 1 << 20), np.uint8)
    model = language.Filter(["aa", "bb"], table)
    for bit, own in ((1, hashes[owner == 0]), (2, hashes[owner % 2 == 1][::7])):
        for at in model._places(own):
            table[0, at] |= np.uint8(bit)
    model = language.Filter(["aa", "bb"], table)
    total, found = model.hits(hashes, owner, len(texts))
    of_a = owner % 2 == 0
    expected = {name: dict(zip(*(x.tolist() for x in np.unique(hashes[own], return_counts=True)))) for name, own in (("aa", of_a), ("bb", ~of_a))}
    del hashes, owner, of_a

    def held(run):
        tracemalloc.start()
        out = list(run)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak >> 20

    counted, most = held(language._count([batch]))
    got = {"aa": defaultdict(int), "bb": defaultdict(int)}
    for b in counted:
        for name, gram, n in zip(*(b.column(c).to_pylist() for c in ("lang", "gram", "n"))):
            got[name][gram % 2**64] += n
    assert got == expected and most < 60, most
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("coverage", pa.float64())])
    predicted, most = held(language._predict(type("Shared", (), {"value": model}), 0, schema)([batch]))
    share = np.clip((found / total[:, None] - model.chance) / (1 - model.chance), 0, 1)
    rows = pa.Table.from_batches(predicted).to_pydict()
    assert rows["coverage"] == share.max(1).tolist() and rows["lang_pred"] == [model.languages[i] for i in share.argmax(1)]
    assert most < 60, most


def test_parts_of_a_text_have_its_grams(monkeypatch):
    texts = [*(t or "" for t in TEXTS if len(t or "") < 2000), "ab" + " " * 50 + "cd", "   ab", "é", "a\U00030000 \U00030001x日b" * 3]
    for size in (4, 5, 7, 64):
        monkeypatch.setattr(language, "SLICE", size)
        for t in texts:
            one = language.string_buffers(language.pa.array([t]))
            hashes, _, letters = language.grams(*one)
            cut = list(language.parts(*one))
            assert sorted(np.concatenate([c[0] for c in cut]).tolist()) == sorted(hashes.tolist()) and sum(c[2] for c in cut) == letters
            assert len(cut) > 1 or len(one[0]) <= size


# 3 URLs


def brute_url(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = max(((len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
    return host, path, best[1], best[2]


def test_urls(spark):
    some = [None, "", "no scheme", "http://", "http://Www.Example.ORG/es/1?x=/de/", "https://a.b.com/de/x#y", "x://com/fr/", "ftp://notexample.org", "http://org", "http://example.org/en/12", "http://example.org?u=://z/", "http://ÉX.net/a\nb", "http://xorg/"]
    some += [f"http://h{i}.{t}/{p}/{i}" for i in range(60) for t, p in (("org", "q"), ("com", "fr"), ("com", "de"), ("net", "de"), ("net", "fr"))]
    rows = [(i, u, "h", "s") for i, u in enumerate(some)] + [(0, some[5], "h", "s"), (None, "http://x.org/", "h", "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, score string")
    got = urls.judged(df).collect()
    assert len(got) == len(rows)
    by = sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"]) for r in got)))
    assert by == sorted(map(str, ((i, *brute_url(u)[:3]) for i, u, *_ in rows)))
    for r in got:
        if r["rule"] is not None:
            assert r["verdict"] == next(v for v, h, p in urls.RULES if h + p == r["rule"])
        else:
            assert r["verdict"] == ("allow" if r["score"] >= r["threshold"] else "block")
    assert urls.judged(df.limit(0)).count() == 0


def test_copies_of_a_url_do_not_fill_the_fit(spark):
    urls_ = [f"http://a{i}.{end}" for i in range(60) for end in ("org/x", "com/de/y", "net/z")]
    scores = []
    for copies in (1, 40):
        rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls_) for _ in range(copies)], "page_id long, url string")
        scores.append({(r["page_id"], r["score"], r["threshold"]) for r in urls.judged(rows, fit_rows=30).collect()})
    assert scores[0] == scores[1]


def test_ratio_decides_unruled_urls():
    accepted = [f"http://h{i}.{t}/{p}/{i}" for i in range(60) for t, p in (("org", "q"), ("com", "fr"))]
    ratio = urls.Ratio(accepted, [f"http://h{i}.com/de/{i}" for i in range(60)])
    assert all(ratio(f"http://h{i}.net/fr/{i}") >= ratio.threshold > ratio(f"http://h{i}.net/de/{i}") for i in range(60))
    assert urls.Ratio([], []).threshold == 0 == urls.Ratio([], [])("http://x/")


class BruteMarkov:
    """Witten-Bell interpolation from dicts of counts."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {}
        for text in texts:
            line = "\x02" * order + text + "\x03"
            for i in range(order, len(line)):
                for k in range(order + 1):
                    seen = self.counts.setdefault(line[i - k : i], defaultdict(int))
                    seen[line[i]] += 1

    def probability(self, context, char):
        p = 1 / 1114112
        for k in range(len(context) + 1):
            seen = self.counts.get(context[len(context) - k :], {})
            if sum(seen.values()) < (2 if k >= 2 else 1):
                break
            p = (seen.get(char, 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p


def test_scores_of_urls_by_brute_force():
    r = random.Random(9)
    make = lambda: "http://" + "".join(r.choice("abcé/.") for _ in range(r.randrange(30)))
    accepted, rejected = ([make() for _ in range(80)] for _ in range(2))
    ratio = urls.Ratio(accepted, rejected)
    held = lambda u: zlib.crc32(u.encode()) % 4 == 0
    slow = [BruteMarkov([u for u in side if not held(u)], urls.ORDER) for side in (accepted, rejected)]
    asked = accepted[:20] + rejected[:20] + ["", "☃", "http://" + "a" * 5000]
    for url, got in zip(asked, ratio.scores(asked)):
        line, total = "\x02" * urls.ORDER + url + "\x03", 0.0
        for i in range(urls.ORDER, len(line)):
            p, q = (m.probability(line[i - urls.ORDER : i], line[i]) for m in slow)
            total += np.log(p / q)
        assert abs(got - total / (len(url) + 1)) < 1e-9
        assert abs(ratio(url) - got) < 1e-12


def test_markov_is_a_distribution():
    model = urls.Markov(["http://abc/", "http://abd/"], 3)
    known = "htp:/abcd\x03"
    rest = (1114112 - len(known)) * model.probability("p:/", "☃")
    assert abs(sum(model.probability("p:/", c) for c in known) + rest - 1) < 1e-9


def test_long_urls_are_learnt_by_windows(spark):
    long = "http://a.com/de/" + "".join(random.Random(1).choice("mnop") for _ in range(5000))
    got = urls.learnt_of(spark.createDataFrame([(long,), ("http://b.com/de/x",)], "url string"), 10)
    assert sorted(w for _, w, _ in got) == [1, -(-len(long) // urls.WINDOW)]
    for window, weight, start in got:
        assert window in long or window == "http://b.com/de/x"
        assert len(window) <= urls.WINDOW + urls.ORDER and (weight > 1) == (len(window) - start == urls.WINDOW)
    # what is context only is not learnt, and the rest counts with its weight
    model = urls.Markov(["abcd"], 2, [5], [2])
    names, total, kinds, grams, n = model.tables[0]
    assert total.tolist() == [15] and sorted(n.tolist()) == [5, 5, 5]


def ratio_of_all(urls_):
    """The ratio of all distinct urls that the rules decide, whole, in memory."""
    sides = {"allow": set(), "block": set()}
    for u in urls_:
        if verdict := brute_url(u)[3]:
            sides[verdict].add(u)
    return urls.Ratio(*map(sorted, sides.values()))


def test_all_urls_are_learnt_whole(spark):
    r = random.Random(5)
    long = "http://a.com/de/" + "".join(r.choice("mnopé☃") for _ in range(3000))
    urls_ = [f"http://{r.choice('abcd')}{i}.org/{r.choice(['en', 'fr'])}/{r.randrange(10**6)}" for i in range(12_000)]
    urls_ += [f"http://{r.choice('abcd')}{i}.com/de/{r.choice(['', 'en/'])}{r.randrange(10**6)}" for i in range(300)]
    urls_ += [long, long + "x", "http://b.org/" + "q" * 200, "http://c.net/de/7", "http://c.net/" + long[-500:], "", "\0\x02", "x\0\0", "http://\U0010ffff.org/"]
    ratio = ratio_of_all(urls_)
    rows = spark.createDataFrame(list(enumerate([*urls_, None, long])), "page_id long, url string")
    got = sorted(urls.judged(rows).collect(), key=lambda x: x["page_id"])
    assert len(got) == len(urls_) + 2 and got[-1]["score"] == got[urls_.index(long)]["score"] and got[-2]["score"] == got[urls_.index("")]["score"]
    assert np.abs(np.array([x["score"] for x in got[: len(urls_)]]) - ratio.scores(urls_)).max() < 1e-9
    assert {round(x["threshold"] - ratio.threshold, 9) for x in got} == {0}


@pytest.mark.parametrize("good, bad", [(60, 50), (40, 0), (0, 40), (1, 1)])
def test_pieces_and_blocks_of_urls_do_not_change_scores(spark, good, bad):
    r = random.Random(good + 2 * bad)
    word = lambda: "".join(r.choice("abcé/.") for _ in range(r.choice([0, 1, 5, 30, 200])))
    urls_ = [f"http://{i}.org/{word()}" for i in range(good)] + [f"http://{i}.com/de/{word()}" for i in range(bad)] + [f"http://{i}.net/{word()}" for i in range(20)]
    ratio, found = ratio_of_all(urls_), urls.rule_of(urls.host_of(F.col("url")), urls.path_of(F.col("url")))
    rows = spark.createDataFrame(list(enumerate(urls_)) * 2, "page_id long, url string")
    got, threshold = urls.scored(rows, found, urls.Workspace(spark), span=7, block=40)
    got = got.collect()
    assert len(got) == 2 * len(urls_) and abs(threshold - ratio.threshold) < 1e-9
    for x, score in zip(got, ratio.scores([x["url"] for x in got])):
        assert urls_[x["page_id"]] == x["url"] and abs(x["score"] - score) < 1e-9


def test_threshold_of_many_scores_in_ranges(spark):
    r = random.Random(3)
    for n, spread in [(0, 3), (1, 3), (400, 3), (400, 200)]:
        pairs = [((r.randrange(spread) - spread // 2 + kind) / 8, kind) for _ in range(n) for kind in (0, 1)]
        expected = urls.Ratio._calibrated(*[[s for s, kind in pairs if kind == k] for k in (1, 0)])
        assert urls.threshold_of(spark.createDataFrame(pairs, "score double, good long"), urls.Workspace(spark)) == expected


def test_models_are_bounded():
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefghijklmnop") for _ in range(120)) for _ in range(200)]
    before = urls.MODEL_BYTES
    try:
        urls.MODEL_BYTES = 300_000
        ratio = urls.Ratio(texts[:100], texts[100:])
        assert sum(m.nbytes() for m in ratio.models) <= 300_000 and np.isfinite(ratio.scores(texts)).all()
    finally:
        urls.MODEL_BYTES = before


# 4 fingerprints


def test_fingerprints(spark, docs, empty):
    rows = [(i * 7 % 101, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    got = {r["doc_id"]: r for r in editwalk.fingerprinted(df).collect()}
    assert len(got) == len(rows)
    marks = {}
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following, r = t or "", following or "", got[i]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r["fingerprint"] == marks.setdefault(t, r["fingerprint"]) and 0 <= r["near_next"] <= 1
        a, b = editwalk.fingerprints([t, new])
        assert (r["fingerprint"], r["edited_fingerprint"], r["near_edited"]) == (editwalk.text_form(a), editwalk.text_form(b), editwalk.likeness(a, b))
    assert editwalk.fingerprinted(docs).count() == len(ROWS)
    assert editwalk.fingerprinted(empty).count() == 0
    for i, t in rows:
        following = next(x for j, x in zip(sorted((j for j, _ in rows), reverse=True), [x for _, x in order[1:] + order[:1]]) if j == i) or ""
        f, g = editwalk.fingerprints([t or "", following])
        assert got[i]["bands_next"] == sum(bool((f[k : k + 8] == g[k : k + 8]).all()) for k in range(0, 256, 8))
        assert got[i]["edits_next"] == (editwalk.edit_distance(t or "", following) if got[i]["bands_next"] else None)
    one = editwalk.fingerprinted(df.where("doc_id = 42")).first()
    assert one["near_next"] == 1.0


def test_walks_follow_the_embedding():
    texts = [prose(40, i) for i in range(60)] + ["", "a", prose(3000, 7)]
    walked = editwalk.walks(texts)
    for (points, left), t in zip(walked, texts):
        assert len(points) == len(left) == len(t)
        step = 0
        for c, end in zip(points.tolist(), left.tolist()):
            kind = int(editwalk.mix(np.array([c], np.uint64))[0] & np.uint64(255))
            while not bit(kind, step):
                step += 1
            step += 1
            assert step == end


def bit(kind, step):
    """The shared random bit of a kind of character at a step, from the tables of bits alone."""
    period, j = divmod(step, editwalk.PERIOD)
    return editwalk._BITS[kind ^ int(editwalk._TURN[period & 65535]) // editwalk.PERIOD, j]


def test_fingerprints_by_brute_force():
    """The digits from a walk step by step: each sample's first step, in its own order, that the walk reached."""
    for text in ("a", "ab", prose(30, 5), prose(2500, 6)):
        at, written = 0, []
        while at < len(text):
            kind = int(editwalk.mix(np.array([ord(text[at])], np.uint64))[0] & np.uint64(255))
            written.append(ord(text[at]))
            at += int(bit(kind, len(written) - 1))
        got = editwalk.fingerprints([text])[0]
        for s in range(editwalk.SAMPLES):
            reached = [x for x in editwalk._RECORDS[s].tolist() if x < len(written)]
            value = editwalk.mix(np.array([written[reached[-1]]], np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ editwalk._SALTS[s])[0] & np.uint64(15)
            assert got[s] == value
    assert len(written) > 2 * editwalk.PERIOD
    rows = [editwalk._BITS[60 ^ int(t) // editwalk.PERIOD].tobytes() for t in editwalk._TURN[:5]]
    assert len(set(rows)) > 3  # a character's bits don't repeat with the period


def test_rows_of_one_id_are_split(spark):
    """Two thirds of the rows have one id, or none: each still has the next one of a total order as its next."""
    for hot in (5, None):
        rows = [(hot, f"text {i} of one id") for i in range(80)] + [(hot, "twice")] * 2 + [(i, f"other {i}") for i in range(40) if i != 5]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        tied = df.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
        buckets = tied.groupBy(editwalk._ranges(tied, 8).alias("b")).count().collect()
        assert max(r["count"] for r in buckets) < 60 and len(buckets) >= 6
        order = sorted(((-r["doc_id"], r["tie"], r["text"]) for r in tied.collect()))
        expected = []
        for (d, _, t), (_, _, following) in zip(order, order[1:] + order[:1]):
            half = len(t) // 2
            expected.append((None if d == 2**63 else -d, hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
        got = [(r["doc_id"], r["edited_sha256"]) for r in editwalk.fingerprinted(df).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(6)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(14))) for _ in range(2))
        assert editwalk.edit_distance(a, b) == slow(a, b)
        assert editwalk.edit_distance("xyz" + a + "uu", "xyz" + b + "uu") == slow(a, b)


def test_near_by_edits(spark, empty):
    base = [prose(150, 40 + i) for i in range(8)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:300] + "q" + t[302:]) for i, t in enumerate(base)] + [(200, base[0]), (201, None), (202, "")]
    got = {r["doc_id"]: r["component_id"] for r in editwalk.near_by_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in (*range(8), 201, 202)) and got[200] == 0
    assert sum(got[100 + i] == i for i in range(8)) >= 7
    assert editwalk.near_by_edits(empty).count() == 0


def test_near_by_edits_finds_edits_all_over(spark):
    rows = []
    for i, (n, percent) in enumerate([(n, p) for n in (500, 2000, 10_000) for p in (1, 4.5) for _ in range(4)]):
        r, text = random.Random(i), prose(n, 700 + i)[:n]
        chars = list(text)
        for _ in range(int(n * percent / 100)):
            k, at = r.randrange(3), r.randrange(len(chars))
            chars[at : at + (k > 0)] = [r.choice("abcdefgh")] if k < 2 else []
        assert editwalk.edit_distance(text, "".join(chars)) * 20 <= max(n, len(chars))
        rows += [(2 * i, text), (2 * i + 1, "".join(chars))]
    got = {r["doc_id"]: r["component_id"] for r in editwalk.near_by_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] in (i, i - i % 2) for i in got)
    assert sum(got[i] == i - 1 for i in got if i % 2) >= 0.9 * len(rows) / 2


# 5 chat


def test_chat(spark):
    tricky = ["\\### Assistant: </turn> ok", "\\l\\s\\n<turn user>\n</turn>\n", "", None, "<", "\\", "\n", "日本\\<é"]
    rows = [(c, t, ["user", "assistant", None, "a>\n<b"][(c + t) % 4], tricky[(c * 3 + t) % 8], "f") for c in range(9) for t in range(c)]
    rows += [(50, 1, "assistant", "x" * 20_000, "f"), (50, 1, "assistant", "x" * 20_000, "f"), (50, None, "user", "b", "f"), (None, 0, "assistant", "n", "f")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.expand(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        r = got[c]
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat.expand(df).where("conv_id = 7").orderBy("example").collect()
    assert all(r["formatted"][r["loss_start"] + r["loss_length"] :] == "</turn>\n" for r in examples if r["loss_length"])
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


# 6 sharding


def test_sharding(docs, empty, spark):
    rows = sharding.interleave(docs, bucket_rows=7).collect()
    assert len(rows) == len(ROWS)
    key = lambda d, t, s: (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s)
    assert sorted(map(str, ((str(r["doc_id"]), r["size"], r["text_crc32"], r["source"]) for r in rows))) == sorted(str(key(r[0], r[1], r[3])) for r in ROWS)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.interleave(empty).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    placed = sharding.interleave(many, bucket_rows=300)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in placed.collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.interleave(many).collect()}
    share = placed.groupBy("source", "shard").count().groupBy("source").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert max(r["d"] for r in share) <= 2


def test_rows_of_one_id_go_to_many_buckets(spark):
    rows = [(None, f"text {i}", "s") for i in range(3000)]
    placed = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), bucket_rows=100).collect()
    assert sorted(r["position"] for r in placed) == list(range(3000))
    assert [r["text_crc32"] for r in sorted(placed, key=lambda r: r["position"])] != sorted(r["text_crc32"] for r in placed)


# 8 decontamination


def words8(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_hits(text, items, n=13):
    w = words8(text)
    hit, found = set(), set()
    for name, item in items:
        v = words8(item)
        k = min(n, len(v))
        wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in wins:
                hit.update(range(i, i + k))
                found.add(name)
    return len(w), hit, found


@pytest.mark.parametrize("block_bytes", (1 << 20, 700))
def test_decontaminate(docs, empty, spark, block_bytes):
    items = [(1, BASE[0]), (2, " ".join(BASE[1].split()[5:25]).upper().replace(" ", "--")), (3, "one two"), (4, None), (5, ""), (6, "text of one"), (6, BASE[2]), (7, "日本語"), (8, " ".join(prose(20_000, 99).split()[700:715]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(str(i), t) for i, t in items]
    expected = []
    for r in ROWS:
        n, hit, found = brute_hits(r[1], named)
        expected.append(str((r[0], n, len(hit), len(found), decontaminate.items_digest(list(found)), bool(hit) and 20 * len(hit) >= n)))
    got = decontaminate.judged(docs, bench, block_bytes=block_bytes)
    assert sorted(str(tuple(r)[:6]) for r in got.collect()) == sorted(expected)
    kept = decontaminate.decontaminate(docs, bench, block_bytes=block_bytes)
    assert kept.schema == docs.schema
    rows = kept.collect()
    assert len(rows) == sum(x.endswith("False)") for x in expected)
    before = {r[1] for r in ROWS}
    for r in rows:
        assert not brute_hits(r["text"], named)[1]
        assert r["text"] in before or r["n_chars"] == len(r["text"])
    assert decontaminate.judged(empty, bench).count() == 0
    assert decontaminate.judged(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


# 10 quality


def test_windows_of_items_are_flat_and_parts_lose_none(spark):
    text = prose(60_000, 77)
    windows = decontaminate.Windows([("a", text), ("b", text), ("c", "only three words"), ("d", "")], 13)
    assert windows.nbytes() < 12 * 2 * len(text) + (10 << 20)  # and the bitmap
    data, offsets = decontaminate.string_buffers(decontaminate.pa.array(["x " + text[:2000] + " only THREE words."]))
    found = list(windows.occurrences(decontaminate.Words(data, offsets, decontaminate.ALPHANUMERIC)))
    assert {n for _, k, names in found for n in names if k == 13} == {"a", "b"} and [names for _, k, names in found if k == 3] == [{"c"}]
    bench = spark.createDataFrame([("1", text), ("1", text), ("2", "é" * 9000), ("3", "some words " * 3), ("4", "")], "item string, text string")
    parts = bench.mapInArrow(decontaminate._parts(13, 5000), "item string, text string").collect()
    own = [words8(r["text"]) for r in parts if r["item"] == "1"]
    assert all(len(r["text"].encode()) <= 5000 for r in parts if r["item"] == "1")
    grams = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    assert set().union(*map(grams, own)) == grams(words8(text)) and min(map(len, own)) >= 13
    assert [r["text"] for r in parts if r["item"] != "1"] == ["é" * 9000, "some words " * 3, ""]
    docs = spark.createDataFrame([(1, text[100_000:101_000]), (2, "nothing of it")], "doc_id long, text string")
    bench = bench.select(F.col("item").alias("item_id"), "text")
    got = {tuple(r) for r in decontaminate.judged(docs, bench, block_bytes=20_000).drop("items_sha256", "items").collect()}
    assert got == {tuple(r) for r in decontaminate.judged(docs, bench).drop("items_sha256", "items").collect()} and any(r[2] for r in got)


def test_quality(docs, empty, spark):
    good = [(i, prose(80, i)) for i in range(120)]
    bad = [(200 + i, edited(prose(400, i), 1, i) + " " + " ".join(["%%% BUY!!"] * 80)) for i in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(3, None), (None, 0), (5, 1)], "doc_id long, quality int")
    model = quality.fit(df.where("doc_id % 4 > 0"), labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert sum((got[i] >= quality.THRESHOLD) == (i < 200) for i in got) >= 0.97 * len(got)
    found = quality.score(docs, model)
    assert found.columns == [*docs.columns, "score"] and found.count() == len(ROWS)
    assert all(0 <= r[-1] <= 1 for r in found.collect())
    assert quality.score(empty, model).count() == 0
    assert {r[-1] for r in quality.score(docs, quality.fit(empty, labels)).collect()} == {0.5}


def brute_features(passage):
    """What `encode` says of one passage, from its bytes."""
    kinds = defaultdict(int)
    for b in passage:
        c = chr(b)
        kind = "lead" if b >= 0xC0 else "more" if b >= 0x80 else "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "blank" if c == " " else "control" if b < 32 or b == 127 else c
        kinds[kind] += 1
    return sorted(round(float(np.sqrt(n / len(passage))), 5) for n in kinds.values())


def test_encoding_by_brute_force():
    texts = ["", "Ab1 \n!?é", "word word other word", prose(700, 4), "x" * 2500, "a a b"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    x, numbers = quality.encode(data, np.cumsum([0, *map(len, raw)]))
    assert numbers.tolist() == [max(1, -(-len(t) // quality.PASSAGE)) for t in raw] and not x[0].any()
    at = 0
    for t, n in zip(raw, numbers.tolist()):
        for i in range(n):
            passage = t[len(t) * i // n : len(t) * (i + 1) // n]
            if passage:
                got = x[at + i]
                assert sorted(round(float(v), 5) for v in got[: quality.N_KINDS] if v) == brute_features(passage)
            at_words = passage.split()
            if n == 1 and at_words:
                assert abs(got[-4] - sum(a == b for a, b in zip(at_words, at_words[1:])) / len(at_words)) < 1e-6
                assert abs(got[-3] - len(set(at_words)) / len(at_words)) < 1e-6
                assert abs(got[-2] - np.log1p(sum(map(len, at_words)) / len(at_words))) < 1e-5
                assert abs(got[-1] - np.log1p(100 * len(at_words) / len(passage))) < 1e-5
        at += n


def test_attention_by_brute_force():
    r = np.random.default_rng(5)
    model, numbers = quality.Attention(4, seed=2), np.array([1, 4, 2])
    x = r.standard_normal((7, 4))
    got, at = model.forward(x, numbers)[0], 0
    for n, score in zip(numbers, got):
        p, weights, values = model.p, [], []
        for row in x[at : at + n]:
            h = np.array([np.tanh(sum(row[i] * p["W"][i, j] for i in range(4)) + p["b"][j]) for j in range(quality.HIDDEN)])
            gate = [np.tanh(h @ p["V"][:, g]) / (1 + np.exp(-(h @ p["U"][:, g]))) for g in range(quality.GATE)]
            weights.append(np.exp(sum(w * g for w, g in zip(p["w"], gate))))
            values.append(h @ p["c"])
        assert abs(score - 1 / (1 + np.exp(-(np.dot(weights, values) / sum(weights) + p["d"][0])))) < 1e-9
        at += n


def test_fit_of_long_and_repeated_rows(spark):
    assert quality.spread(5).tolist() == list(range(5))
    far = quality.spread(1000)
    assert len(far) == quality.FIT_PASSAGES and (np.diff(far) > 10).all() and far[0] < 16 and far[-1] > 980
    rows = [(1, prose(20, i)) for i in range(300)] + [(2, "%% BUY " * 30000)] * 3
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, fit_rows=200)
    assert model.base is None  # the long texts are learnt too


def test_gradient():
    r = np.random.default_rng(2)
    model, numbers, y = quality.Attention(5), np.array([1, 3, 2]), np.array([0.0, 1.0, 1.0])
    x = r.standard_normal((6, 5))
    loss = lambda: -np.mean(y * np.log(p := model.forward(x, numbers)[0]) + (1 - y) * np.log(1 - p))
    grad = model._gradient(x, numbers, y, 0.0)
    for k, g in grad.items():
        for at in list(np.ndindex(g.shape))[:6]:
            old = model.p[k][at]
            model.p[k][at] = old + 1e-5
            up = loss()
            model.p[k][at] = old - 1e-5
            down = loss()
            model.p[k][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6
