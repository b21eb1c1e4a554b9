"""Each stage of the pipeline against brute force on what the stage before has written."""

from collections import Counter

import numpy as np
import pytest
from test_near_texts import brute_roots
from test_operators import brute_lines

import __spark_entry__
import corpus_pipeline
from mixfield.llm import packing, queries

DATA = "/root/testdata/sf0.001"
ODD = [(9001, None, "en", "src1"), (9002, "123 !!", None, None), (9003, "", "de", "src2"), (9004, "plain words of text here", None, None), (9004, "plain words of text here", None, None)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], docs.schema)
    docs = docs.unionByName(more)
    out = [docs.collect()]
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, DATA).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs.collect())
        if name != "pack":
            assert docs.dtypes == spark.read.parquet(f"{DATA}/documents.parquet").dtypes
    return out


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "pack"]
    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run


def test_language_stage(stages):
    before, after = stages[0], stages[1]
    keep = [r for r in before if r.text and any(c.isalpha() for c in r.text)]
    assert Counter((r.doc_id, r.text, r.source) for r in after) == Counter((r.doc_id, r.text, r.source) for r in keep)
    assert all(r.lang for r in after)


def test_line_stage(stages):
    before, after = stages[1], stages[2]
    want = brute_lines({r.doc_id: r.text for r in before}, 3)
    original = {r.doc_id: r.text for r in before}
    kept = {d: t for d, t in want.items() if t or not original[d]}
    assert {r.doc_id: r.text for r in after} == kept
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_duplicate_stage(stages):
    before, after = stages[2], stages[3]
    first = {}
    for r, root in zip(before, brute_roots([r.text for r in before]), strict=True):
        first[root] = min(first.get(root, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(first.values())


def test_mixing_stage(stages):
    before, after = stages[3], stages[4]
    words = {r.doc_id: r.text.encode().split() for r in before}
    size, taken, source = Counter(), Counter(), {r.doc_id: r.source for r in before}
    for d, w in words.items():
        size[source[d]] += len(w)
    readings = Counter()
    for r in after:
        own = r.text.encode().split()
        joined, part = b" ".join(words[r.doc_id]), b" ".join(own)
        assert part and part in joined
        taken[source[r.doc_id]] += len(own)
        readings[r.doc_id] += 1
    assert max(readings.values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.02 * sum(size.values())
    assert all(taken[s] <= 2 * size[s] for s in size)


def test_packing_stage(stages):
    before, pieces = stages[4], stages[5]
    encoding = packing._encoding(queries.ranks_path())
    want = Counter()
    for r in before:
        want[r.doc_id] += len(encoding.encode_ordinary(r.text)) + 1
    got = Counter()
    for p in pieces:
        assert len(np.frombuffer(p.ids, "<u4")) == p.length
        got[p.doc_id] += p.length
    assert got == want


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 100


def test_mixing_stage_with_null_and_repeated_ids(spark):
    """Rows without doc_id, of the same doc_id and repeated rows are each read as often as the mix says, and never crossed with each other."""
    texts = [f"words of text number {i} " * (3 + i % 5) for i in range(12)]
    rows = [(None, t.strip(), "en", "a") for t in texts[:4]] + [(3, t.strip(), "en", "a") for t in texts[4:6]] + [(7, texts[6].strip(), "de", "b")] * 5 + [(i + 20, t.strip(), "de", None) for i, t in enumerate(texts[7:])] + [(None, texts[0].strip(), "fr", "b")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = corpus_pipeline.mix_sources(spark, docs, DATA).collect()
    mixed = corpus_pipeline.mixing.mix(docs).collect()
    words = lambda t: len(t.split())
    assert len(found) == sum(len([p for p in r.passes if p.words]) for r in mixed)
    assert sum(words(r.text) for r in found) == sum(r.taken for r in mixed)
    taken = Counter()
    for r in mixed:
        taken[r.doc_id, r.source] += r.taken
    assert Counter(taken) == sum((Counter({(r.doc_id, r.source): words(r.text)}) for r in found), Counter())
    whole = {t.strip() for t in texts}
    assert all(any(r.text in t for t in whole) for r in found)
    readings = Counter((r.doc_id, r.source, r.text) for r in found)
    copies = Counter((d, s, t) for d, t, _, s in rows)
    assert all(n <= 2 * copies[k] for k, n in readings.items() if k[2] in whole)
