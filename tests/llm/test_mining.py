"""Phrase mining, the chosen-path similarity join and ranked search against brute force on small tables."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixfield.llm import minhash, phrases, ranking

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made(seed: int, n: int, words: int = 40, vocabulary: int = 12, marks: str = " ,.;\n\t") -> list[str]:
    rng = random.Random(seed)
    known = [f"w{i}" for i in range(vocabulary)] + ["É", "x y"]
    return ["".join(rng.choice(known) + (rng.choice(marks) if rng.random() < 0.2 else " ") for _ in range(rng.randrange(words))) for _ in range(n)]


# Phrases


def brute_phrases(rows, least, cover=80, top=2000, longest=4):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    frequent = {g: a for g, a in counts.items() if a >= least and len(g[1]) > 1}
    out = []
    for lang in n:
        own = []
        for (x, g), a in frequent.items():
            if x != lang:
                continue
            inside = [b for (y, h), b in frequent.items() if y == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * b >= cover * a for b in inside):
                continue
            cuts = [(2_000_000 * a // (counts[lang, g[:k]] + counts[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            own.append((-score, -a, " ".join(g).encode(), counts[lang, g[:k]], counts[lang, g[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, x, 1, 2, 3) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, a int, rank int, words int").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least", [2, 5])
def test_phrases(spark, least):
    texts = made(1, 60) + ["A b c. a B c d, a b c d e f"] * 7 + [None, "", " \t ", ".,;", "same same same same same"]
    rows = [(random.Random(i).choice(["en", "de", None]), t) for i, t in enumerate(texts)]
    want = brute_phrases(rows, least)
    assert len(want) >= 10 and mined(spark, rows, least=least) == want


def test_phrases_first_of_many_and_a_saturated_bitmap(spark, monkeypatch):
    rows = [("en", t) for t in made(2, 80, vocabulary=6)]
    assert mined(spark, rows, least=3, top=9) == brute_phrases(rows, 3, top=9)
    # a bitmap that lets everything through costs work and no result
    monkeypatch.setattr(phrases, "BITS_MOST", 1024)
    monkeypatch.setattr(phrases, "WINDOWS", 50)
    monkeypatch.setattr(phrases, "DISTINCT", 5)
    monkeypatch.setattr(phrases, "ROW", 4)
    assert mined(spark, rows, least=3) == brute_phrases(rows, 3)


def test_phrases_of_nothing_and_of_a_long_text(spark):
    assert mined(spark, []) == []
    assert mined(spark, [("en", None), (None, "once only")], least=2) == []
    rows = [("en", "one two three " * 30_000), ("en", "one two")]
    found = mined(spark, rows, least=2)
    assert found and found == brute_phrases(rows, 2)


def test_numbers_are_tried_again_until_no_two_words_share_one(spark, monkeypatch):
    class Colliding(phrases._Numbers):
        def __init__(self, lang, attempt):
            super().__init__(lang, attempt)
            if attempt == 0:
                self.hash = lambda word, seed: len(word)

    monkeypatch.setattr(phrases, "_Numbers", Colliding)
    words = spark.createDataFrame([("en", "ab", 5), ("en", "cd", 1), ("en", "e", 9)], "lang string, word string, a long")
    found, attempt = phrases.numbered_words(words, 3)
    assert attempt == 1 and sorted(r.word for r in found.collect()) == ["ab", "e"]


def test_windows_by_hand():
    flat = np.array([5, 6, 7, 0, 8, 9, 0], np.uint64)
    assert phrases.windows(flat, 1).tolist() == [0, 1, 2, 4, 5]
    assert phrases.windows(flat, 2).tolist() == [0, 1, 4] and phrases.windows(flat, 3).tolist() == [0]
    # windows at 0 and 4 survive: two pieces
    assert phrases.chains(flat, np.array([0, 4]), 2).tolist() == [5, 6, 0, 8, 9, 0]
    assert phrases.chains(flat, np.array([0, 1]), 2).tolist() == [5, 6, 7, 0]


def test_groups_that_share_a_number_are_told_apart():
    rng = np.random.default_rng(5)
    columns = [rng.integers(0, 6, 400).astype(np.uint64) for _ in range(2)]
    n = rng.integers(1, 4, 400)
    once, times = Counter(zip(*(c.tolist() for c in columns), strict=True)), Counter()
    for *group, k in zip(*(c.tolist() for c in columns), n.tolist(), strict=True):
        times[tuple(group)] += k
    for h in (phrases._mixed(columns), np.zeros(400, np.uint64), columns[0] % np.uint64(2)):
        for counts, want in ((None, once), (n, times)):
            _, found, a = phrases._summed(h, columns, counts)
            assert len(a) == len(want) and dict(zip(zip(*(c.tolist() for c in found), strict=True), a.tolist(), strict=True)) == want


def test_groups_are_counted_in_buckets_and_few_words_are_remembered(spark, monkeypatch):
    for name, value in (("BUCKET", 64), ("WINDOWS", 50), ("ROW", 8), ("KNOWN", 7)):
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(4)
    rows = [[rng.randrange(1, 9) if rng.random() < 0.9 else 0 for _ in range(rng.randrange(1, 12))] + [0] for _ in range(120)]
    relation = spark.createDataFrame([(r,) for r in rows], "words array<long>").repartition(3).cache()
    assert phrases.buckets(relation) == 16
    for size in (2, 3):
        want = Counter(tuple(r[i : i + size]) for r in rows for i in range(len(r) - size + 1) if all(r[i : i + size]))
        found = {tuple(r)[:-1]: r.a for r in phrases.group_counts(relation, size, 3).collect()}
        assert found == {g: a for g, a in want.items() if a >= 3}
    numbers = phrases._Numbers("en", 0)
    assert [numbers[str(i).encode()] for i in range(500)] == [phrases._Numbers("en", 0).number(str(i).encode()) for i in range(500)] and len(numbers) <= 50
    rows = [(lang, t) for lang in ("en", "de", "fr") for t in made(8, 40)]
    assert mined(spark, rows, least=3) == brute_phrases(rows, 3)


# Near-duplicates


def brute_components(rows, percent=80, size=4):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def near_rows(seed, groups=6, copies=30, length=120):
    """Groups of copies with up to nine changed words each: around 0.8 of the origin, and less of each other."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        words = [f"v{rng.randrange(5000)}" for _ in range(length)]
        out += [changed(rng, words, rng.randrange(10)) for _ in range(copies)]
    out += [f"alone {i} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for i in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))


def near_found(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 0, "x", 1) for d, t in rows], "doc_id long, text string, n int, node string, tokens int").repartition(3)
    return Counter(tuple(r) for r in minhash.near_duplicates(docs, **options).collect())


@pytest.mark.parametrize("options", [{}, {"small": 4}, {"small": 2, "depth": 1}, {"small": 2, "depth": 0}])
def test_near_duplicates(spark, options):
    """All links are found, also where nodes are far larger than is compared exhaustively and where trees end early."""
    rows = near_rows(3)
    assert near_found(spark, rows, **options) == brute_components(rows)


def test_near_duplicates_at_the_edges(spark):
    five = "a b c d e f g h"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (None, five), (None, five), (9, five.upper()), (9, five.upper()), (9, "other words in this one"), (None, "nobody has this text here"), (12, "é É ß x y"), (13, "é É ß x y")]
    assert near_found(spark, rows) == brute_components_with_nulls(rows)
    assert near_found(spark, []) == Counter()


def brute_components_with_nulls(rows):
    found = brute_components(rows)
    # a row without doc_id is kept if no row of its component has one
    return Counter({(d, n, c, True if d is None and c is None else k): v for (d, n, c, k), v in found.items()})


def test_a_pair_at_the_limit(spark):
    """Eight of ten shingles are 0.8 and linked; seven of nine are not."""
    ten = [f"t{i}" for i in range(12)]  # nine shingles
    rows = [(1, " ".join(ten)), (2, " ".join([*ten, "more"])), (3, " ".join(ten[:-2]))]
    assert near_found(spark, rows) == brute_components(rows)
    # 8 shingles in common of 10
    rows = [(1, " ".join(["x", *ten[:11]])), (2, " ".join([*ten[:11], "y"]))]
    assert near_found(spark, rows) == brute_components(rows) and {c for _, _, c, _ in near_found(spark, rows)} == {1}


def test_tokens_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    agree = [(minhash.minwise_tokens(np.unique(a)) == minhash.minwise_tokens(np.unique(b))).mean() for a, b in ((pool[:500], pool[100:600]), (pool[:300], pool[300:600]), (pool, pool))]
    assert abs(agree[0] - 400 / 600) < 0.2 and agree[1] < 0.1 and agree[2] == 1


def test_very_long_text_and_many_copies(spark):
    rng = random.Random(9)
    long = [f"z{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(0, " ".join(long)), (1, " ".join([*long, "end"])), *((10 + i, "copy of a text that many rows have here") for i in range(300))]
    got = near_found(spark, rows)
    assert {c for d, _, c, _ in got if d >= 10} == {10} and {c for d, _, c, _ in got if d < 10} == {0}


# Ranked search


def brute_ranks(docs, items, top=10):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    texts = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in texts]
    all_docs, length = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in texts for t in c)
    w = {t: math.floor(1000 * math.log((2 * all_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        found = []
        for (d, _), c, size in zip(docs, texts, n, strict=True):
            m = 25 + 75 * size * all_docs // length if length else 0
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return Counter(out)


def ranked(spark, docs, items, **options):
    a = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, score int, terms int").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return Counter(tuple(r) for r in ranking.search(a, b, **options).select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("options", [{}, {"seeds": 1, "block": 2}, {"seeds": 20, "block": 3, "size": 3}, {"top": 3, "seeds": 1}])
def test_search(spark, options, monkeypatch):
    """With hardly any document scored at first, the blocks have to bring the rest; with small shards, lists are cut into many blocks."""
    monkeypatch.setattr(ranking, "VOCABULARY", 60)
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(9000)]
    docs = [(i, " ".join(words[(k := rng.randrange(8000)) : k + rng.randrange(1, 120)])) for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))) for i in range(12)] + [(50, "Unknown termz"), (51, "w1 w1 W1, w2")]
    assert ranked(spark, docs, items, **options) == brute_ranks(docs, items, options.get("top", 10))


def test_search_at_the_edges(spark):
    docs = [(1, None), (2, ""), (3, "?!"), (4, "été_x Y9"), (5, "ÉTÉ x"), (None, "x x x"), (None, "x x x"), (7, "x"), (7, "x"), (8, "y9 " * 5000)]
    items = [(1, "x y9"), (1, "x y9"), (None, "été"), (3, None), (4, "..."), (5, "X-ray y9 y9")]
    assert ranked(spark, docs, items) == brute_ranks(docs, items)
    assert ranked(spark, docs, items, size=1, seeds=1) == brute_ranks(docs, items)
    assert ranked(spark, [], items) == Counter() and ranked(spark, docs, []) == Counter()


def test_whole_numbers_without_bound():
    scoring = ranking.Scoring(3 * 10**10, 10**13)
    n, times = np.array([10**9], np.int64), np.array([10**10, 1], np.int64)
    m = 25 + 75 * 10**9 * 3 * 10**10 // 10**13
    assert scoring.impacts(n, times, np.array([2])).tolist() == [10**9 * t // (1000 * t + 8 * m) for t in (10**10, 1)]


def test_blocks_hold_similar_documents_and_skip_none_that_counts(spark):
    x = np.zeros((40, 4), np.float32)
    x[:20, 0], x[20:, 1] = 1, 1
    groups = ranking.blocks_of(x[np.random.default_rng(1).permutation(40)], 10)
    assert sorted(np.concatenate(groups).tolist()) == list(range(40)) and all(len(g) <= 20 for g in groups)
    docs = spark.createDataFrame([(i, f"a{i % 5} b c{i % 3}") for i in range(50)], "doc_id long, text string")
    forward = ranking.forward_index(docs, {b"b": 0, b"a1": 1, b"c2": 2})
    scoring = ranking.Scoring(50, 150, np.array([5, 3000, 900]))
    rows = ranking.build_blocks(forward, scoring, 3, {1: np.array([0, 1, 2])}, 4).collect()
    there = {r.d: dict(zip(r.terms, scoring.impacts(np.array([r.n]), np.array(r.times), np.array([len(r.times)])).tolist(), strict=True)) for r in forward.collect()}
    assert sorted(d for r in rows for d in r.docs) == sorted(d for d, own in there.items() if 1 in own)
    for r in rows:
        assert dict(zip(r.coordinates, r.largest, strict=True)) == {t: max(there[d].get(t, 0) for d in r.docs) for t in (0, 1, 2) if any(t in there[d] for d in r.docs)}
