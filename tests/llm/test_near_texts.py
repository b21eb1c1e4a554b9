"""Near copies by shingle similarity, and which rows the pipeline's stage keeps of them."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from mixfield.llm import simhash

DATA = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").encode().lower().split()
    return set(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else {tuple(words)}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def brute_roots(texts):
    label = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def test_groups_of_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null")
    rows = docs.collect()
    want = brute_roots([r.text for r in rows])
    found = {r.doc_id: r.root for r in simhash.near_texts(docs).collect()}
    got = [found[r.doc_id] for r in rows]
    assert len(set(want)) < len({r.text for r in rows})
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


@pytest.fixture(scope="module")
def kept(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    text = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(6)]
    near = text[0].replace(text[0].split()[100], "changed", 1)
    assert similarity(text[0], near) > 0.9
    rows = [(1, text[0], "a"), (2, near, "a"), (None, near + " end", "a"), (None, text[1], "a"), (None, text[2], "a"), (None, text[2], "a"), (5, text[3], "a"), (5, text[4], "a"), (6, text[5], "b"), (6, text[5], "a")]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return text, corpus_pipeline.simhash_near_dedup(spark, docs, DATA).collect()


def test_stage_removes_near_copies(kept):
    text, rows = kept
    assert [r.text for r in rows if r.doc_id in (1, 2)] == [text[0]]


def test_stage_keeps_rows_without_or_with_repeated_ids(kept):
    text, rows = kept
    assert Counter((r.doc_id, r.text) for r in rows) == Counter([(1, text[0]), (None, text[1]), (None, text[2]), (5, text[3]), (5, text[4]), (6, text[5])])


def test_large_groups_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = []
    for i in range(120):
        own = list(base)
        for at in rng.sample(range(300), 1 + i % 3):
            own[at] = f"x{i}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.root for r in simhash.near_texts(docs).collect()}
    want = brute_roots(texts)
    assert len(set(want)) == len(set(found.values())) == len(set(zip(want, (found[i] for i in range(120)), strict=True)))


def brute_part_fingerprints(text):
    """Of each power of two that the text may share with a near copy: the majority bits of the shingles dealt to each part."""
    import xxhash

    own = {xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles(text)}
    out = {}
    for power in {len(own).bit_length() - 1, int(len(own) / 0.8).bit_length() - 1}:
        parts = max(24, (1 << max(power - 1, 0)) + 1)
        dealt = {}
        for h in own:
            lot = h * 0x9E3779B97F4A7C15 % (1 << 64)
            dealt.setdefault(((lot ^ (lot >> 32)) >> 1) % parts, []).append(h)
        for part, hashes in dealt.items():
            if part < 24:
                out[power * 24 + part] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out


def test_part_fingerprints_against_brute_force():
    rng = random.Random(3)
    texts = ["", None, "one", "a b c d", "a b c d e"] + [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice((5, 20, 70, 300, 2000)))) for _ in range(40)]
    owner, place, fp = simhash.part_fingerprints([t if t is None else t.encode() for t in texts])
    got = [{} for _ in texts]
    for o, p, f in zip(owner.tolist(), place.tolist(), fp.tolist()):
        assert p not in got[o]
        got[o][p] = f % (1 << 64)
    assert got == [brute_part_fingerprints(t) for t in texts]


def test_texts_at_the_limit_share_fingerprints():
    """At a similarity just over 0.8, with the changes spread out, two texts nearly always share two fingerprints."""
    rng = random.Random(4)
    shared = []
    for n in (40, 100, 126, 250, 500, 1000, 3000) * 30:
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        other = list(words)
        for at in rng.sample(range(n), n):
            changed = list(other)
            changed[at] = f"x{rng.randrange(10**6)}"
            if similarity(" ".join(words), " ".join(changed)) < 0.8:
                break
            other = changed
        owner, place, fp = simhash.part_fingerprints([" ".join(words).encode(), " ".join(other).encode()])
        a, b = ({(p, f) for o, p, f in zip(owner.tolist(), place.tolist(), fp.tolist()) if o == k} for k in (0, 1))
        shared.append(len(a & b))
    assert min(shared) >= 1 and sum(x >= 2 for x in shared) >= len(shared) - 1


@pytest.mark.parametrize("paired", [1, 8])
def test_unrelated_and_near_texts_in_full_cells(spark, monkeypatch, paired):
    """Texts of a very common passage, and groups around several origins that meet in the same cells."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(paired)
    common = " ".join(f"c{i}" for i in range(12))
    texts = [f"{common} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 30))) for _ in range(60)]
    for origin in range(4):
        base = [f"b{origin % 2}_{i}" for i in range(60)] + [f"o{origin}_{i}" for i in range(25)]
        for _ in range(15):
            own = list(base)
            for at in rng.sample(range(85), rng.randrange(3)):
                own[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += ["", " ", "one", "one", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.root for r in simhash.near_texts(docs).collect()}
    want = brute_roots([t or "" for t in texts])
    got = [found[i] for i in range(len(texts))]
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got, strict=True)))


def test_no_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, node string, cell int")
    assert simhash.near_texts(docs).collect() == []


def test_prefix_filter_against_all_pairs(spark):
    rng = random.Random(7)
    texts = []
    for origin in range(3):
        base = [f"o{origin}_{i}" for i in range(70)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], [f"x{rng.randrange(10**6)}"], [own[at], f"common{rng.randrange(3)}"]])
            texts.append(" ".join(own[rng.randrange(3) :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    node = {r.doc_id: r.node for r in docs.select("doc_id", simhash.text_hash(docs.text).alias("node")).collect()}
    rows = spark.createDataFrame([(n, i % 2) for i, n in enumerate(sorted(set(node.values())))], "node long, root long")
    root = {r.node: r.root for r in rows.collect()}
    want = {tuple(sorted((node[i], node[j]))) for i in range(len(texts)) for j in range(i) if root[node[i]] != root[node[j]] and similarity(texts[i], texts[j]) >= 0.8}
    got = {(r.a, r.b) for r in simhash.prefix_pairs(rows, docs).collect()}
    assert want and want <= got and len(got) < 1.5 * len(want) + 200
