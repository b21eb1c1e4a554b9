"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names, for every operator on documents."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixfield.llm import audio, language, lines, mixing, packing, queries, simhash, substrings, toxicity

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n ", "de", None),
    (5, "!!! 123 ???", "de", "b"),
    (6, LONG, "en", "b"),
    (6, LONG, "en", "b"),
    (None, "the quick brown fox jumps over the lazy dog", None, "b"),
    (None, None, None, None),
    (7, "Ärger und Übermut tun selten gut \U0001f600 \u00a0x\x1cy", "de", "c"),
    (8, f"before {PASSAGE} after", "en", "c"),
    (9, f"other {PASSAGE} end", "en", "a"),
    (9, "one\ntwo\nthree\nfour", "en", "a"),
    (10, "zero\none\ntwo\nthree\nfive", "en", "a"),
    (11, "same\nsame\nsame\nsame\nsame", "en", "a"),
]
CLASHING = ("fp", "size", "rank", "cell", "kept", "target", "d", "key", "length", "buckets", "score", "cap", "start", "block", "removed", "pos", "lang_pred", "component_id", "_id", "n_lines")


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).withColumns({c: F.lit("clash") for c in CLASHING}).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return text.encode().split() if text else []


def test_simhash(docs, nothing):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(ROWS)
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in ROWS)
    empty = {r.doc_id: (r.fp, r.component_id) for r in found if r.doc_id in (2, 3, 4)}
    assert empty == {2: (0, 2), 3: (0, 2), 4: (0, 2)}
    assert {r.component_id for r in found if r.doc_id == 6} == {6}
    assert {r.component_id for r in found if r.doc_id is None} == {1, 2}
    assert simhash.near_duplicates(nothing).count() == 0


def test_packing(docs, nothing):
    rows = packing.pack(docs, queries.ranks_path()).collect()
    encoding = packing._encoding(queries.ranks_path())
    want = Counter((r[0], tuple([*encoding.encode_ordinary(r[1] or ""), 0])) for r in ROWS)
    import numpy as np

    used = Counter()
    sequences = {}
    by_doc = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        used[r.doc_id] += r.length
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    assert used == Counter({k: sum(len(t) * n for (d, t), n in want.items() if d == k) for k in {r[0] for r in ROWS}})
    for (doc_id, n), parts in by_doc.items():
        copies = sum(c for (d, t), c in want.items() if d == doc_id and len(t) == n)
        if copies == 1:
            text = next(t for (d, t) in want if d == doc_id and len(t) == n)
            assert tuple(np.concatenate([i for _, i in sorted(parts, key=lambda p: p[0])]).tolist()) == text
    assert packing.pack(nothing, queries.ranks_path()).count() == 0


def test_mixing(docs, nothing):
    found = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in found) == Counter((r[0], r[3], len(words(r[1]))) for r in ROWS)
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum(p.words for p in r.passes)
        assert r.target <= 2 * r.source_size + 1e-9
    by_source = {}
    for r in found:
        by_source.setdefault(r.source, [0, r.target])[0] += r.taken
    for taken, target in by_source.values():
        assert abs(taken - target) <= 0.02 * target + 3
    assert sorted(map(repr, mixing.mix(docs).collect())) == sorted(map(repr, found))
    assert mixing.mix(nothing).count() == 0


def test_substrings(docs, nothing):
    found = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect()}
    assert (8, 62, 0) in found and (9, 62, 60) in found and (6, 60_000, 0) in found and (2, 0, 0) in found
    assert len(substrings.remove_repeats(docs).collect()) == len(ROWS)
    assert substrings.remove_repeats(nothing).count() == 0


def test_lines(docs, nothing):
    found = lines.deduplicate(docs).collect()
    assert len(found) == len(ROWS)
    kept = {r.doc_id: (r.kept, r.n_lines, r.n_removed) for r in found if r.doc_id in (2, 3, 10, 11)}
    assert kept == {2: (None, 0, 0), 3: ("", 1, 0), 10: ("zero\nfive", 5, 3), 11: ("same", 5, 4)}
    assert found[0].cell == "clash" and set(docs.columns) <= set(found[0].asDict())
    assert lines.deduplicate(nothing).count() == 0


def test_lines_by_digest(docs, nothing):
    """What ``of`` gives of the kept texts is what it gives of those that come out without it, for repeated rows and clashing names too."""
    clash = docs.withColumns({c: F.lit(c) for c in ("slot", "bits", "key", "n", "value", "removed", "n_lines")})
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    numbers = ["doc_id", "n_lines", "n_removed", "longest_run"]
    want = lines.deduplicate(clash, runs=True).select(*numbers, digest(F.col("kept")).alias("kept"))
    found = lines.deduplicate(clash, runs=True, of=digest)
    assert set(found.columns) == (set(clash.columns) - {"text"}) | {"kept", "n_removed", "longest_run"}
    assert {r.slot + r.bits + r.key + r.n + r.value + r.removed for r in found.collect()} == {"slotbitskeynvalueremoved"}
    assert Counter(map(tuple, found.select(*numbers, "kept").collect())) == Counter(map(tuple, want.collect()))
    assert lines.deduplicate(nothing, of=digest).count() == 0


def test_language(docs, nothing):
    profiles = language.fit(language.training_rows(docs))
    found = language.identify(docs, profiles).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in ROWS)
    for r in found:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    without = language.fit(language.training_rows(nothing))
    assert {r.lang_pred for r in language.identify(docs, without).collect()} == {"und"}
    assert language.identify(nothing, profiles).count() == 0


def test_audio(docs, nothing):
    found = audio.load(audio.store(docs)).collect()
    assert len(found) == len(ROWS)
    for r in found:
        assert len(r.payload) % 576 == 0 and r.payload and len(r.pcm) == 4 * len(r.payload)
        assert set(r.payload[r.n_bytes :]) <= {255} and len(r.payload) - r.n_bytes <= 576
    assert Counter((r.doc_id, r.payload[: r.n_bytes]) for r in found) == Counter((r[0], (r[1] or "").encode()) for r in ROWS)
    same = {hashlib.sha256(r.media).hexdigest() + r.feature for r in found if r.doc_id == 6}
    assert len(same) == 1
    assert audio.load(audio.store(nothing)).count() == 0


def test_toxicity(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 0), (7, 1), (None, 1), (8, None), (5, 0), (5, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.grade(docs, model).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in ROWS)
    assert all(0 <= r.severity <= 2 for r in found)
    assert toxicity.grade(nothing, model).count() == 0
    unknown = toxicity.fit(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.grade(docs, unknown).collect())


def test_line_dedup_of_very_many_lines(spark):
    """Seconds grow with the lines of a document, not with their square."""
    import time

    def seconds(n: int) -> float:
        rows = [(1, "\n".join(["a", "b", "c"])), (2, "\n".join(["a", "b", "c", *(f"line {i}" for i in range(n))]))]
        began = time.perf_counter()
        found = {r.doc_id: r for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found[2].n_lines == n + 3 and found[2].n_removed == 3 and found[2].kept == "\n".join(f"line {i}" for i in range(n))
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 20 * seconds(10_000) + 20
