"""The registered queries, as they are called by the driver, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mixfield.llm import audio, language, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Documents with null, repeated and clashing values, in a folder like those of the tables."""
    folder = tmp_path_factory.mktemp("odd")
    texts = [(None, "no id at all"), (1, None), (2, ""), (3, " \t\n"), (4, "x<|endoftext|>y"), (5, "<|endoftext|>"), (6, "a  b " * 700), (7, "same text"), (7, "same text"), (7, "other text"), (8, "é" * 5000), (9, "日本語 texte, 123!")]
    rows = [(d, t, "en", "s", len(t or ""), "clash", 1) for d, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, start int").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return str(folder), texts


def tokens(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(queries.ranks_path().replace(".tiktoken", ".json")).encode_batch(texts, add_special_tokens=False)
    return [np.array([*x.ids, 0], "<u4") for x in found]


def check_packing(rows, texts):
    """Pieces hold each document's ids once, in order, and sequences have no gap and no padding."""
    want = defaultdict(list)
    for (d, _), ids in zip(texts, tokens([t or "" for _, t in texts]), strict=True):
        want[d].append(ids)
    filled, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    assert set(pieces) == set(want)
    for d, own in pieces.items():
        possible = Counter((start, len(ids[start : start + n]), zlib.crc32(ids[start : start + n].tobytes()), len(ids)) for ids in want[d] for start, n in {(r.start, r.length) for r in own})
        assert sum(r.length for r in own) == sum(map(len, want[d]))
        assert all(possible[r.start, r.length, r.ids_crc32, r.doc_tokens] for r in own)
        if len(want[d]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at
                at += r.length


def test_packing(spark, documents):
    check_packing(queries.op2_cost_packing(spark, DATA).collect(), [(d, r.text) for d, r in documents.items()])


def test_packing_of_odd_rows(spark, odd_folder):
    folder, texts = odd_folder
    check_packing(queries.op2_cost_packing(spark, folder).collect(), texts)


def decoded(block):
    """The samples of an ADPCM block, one code at a time."""
    steps = audio.step_sizes().tolist()
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = steps[index]
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample + (-change if code & 8 else change)))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(sample)
    return out


def mu_law(code):
    code = ~code & 255
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return -size if code & 128 else size


def a_law(code):
    code ^= 0x55
    size = ((code & 15) << 4) + 8
    if code & 0x70:
        size = (size + 256) << (((code >> 4) & 7) - 1)
    return size if code & 128 else -size


def audio_row(text):
    data = (text or "").encode()
    payload = data + b"\xff" * (-len(data) % 576 if data else 576)
    mu, a = [mu_law(c) for c in payload], [a_law(c) for c in payload]
    blocks = [s for i in range(0, len(payload), 576) for s in decoded(payload[i : i + 576])]
    pcm = b"".join(x.to_bytes(2, "little", signed=True) for s, t in zip(mu, mu[1:] + mu[-1:]) for x in (s, (s + t) // 2))
    loud = [(sum(x * x for x in s) / len(s)) ** 0.5 for s in (mu, a)]
    each = [sum(x * x for x in blocks[i : i + 1145]) / 1145 for i in range(0, len(blocks), 1145)]
    loud.append((sum(each) / len(each)) ** 0.5)
    turns = sum((x < 0) != (y < 0) for x, y in zip(mu, mu[1:]))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    feature = ";".join([*(f"{v:.2f}" for v in loud), str(turns), f"{zlib.crc32(pcm):08x}"])
    return (len(data), len(payload), sha(payload), zlib.crc32(payload[-32:]), feature, len(pcm), sha(pcm))


def check_audio(rows, texts):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature, r.pcm_bytes, r.pcm_sha256) for r in rows)
    assert got == Counter((d, *audio_row(t)) for d, t in texts)
    media = {t: audio.wav((t or "").encode() + b"\xff" * (-len((t or "").encode()) % 576 if t else 576), audio.MU_LAW) for _, t in texts}
    assert Counter((r.doc_id, r.media_bytes, r.media_sha256) for r in rows) == Counter((d, len(media[t]), hashlib.sha256(media[t]).hexdigest()) for d, t in texts)


def test_audio(spark, documents):
    check_audio(queries.op10_telephony_audio(spark, DATA).collect(), [(d, r.text) for d, r in documents.items()])


def test_audio_of_odd_rows(spark, odd_folder):
    folder, texts = odd_folder
    check_audio(queries.op10_telephony_audio(spark, folder).collect(), texts)


def grams(text):
    """The 1-, 2- and 3-grams of a text with one separator between runs of letters, by their code."""
    marked = "".join(c if c.isalpha() else "\0" for c in f" {text.lower()} ")
    while "\0\0" in marked:
        marked = marked.replace("\0\0", "\0")
    found = Counter(c for c in marked if c != "\0")
    found.update(marked[i : i + 2] for i in range(len(marked) - 1))
    found.update(marked[i : i + 3] for i in range(len(marked) - 2) if marked[i + 1] != "\0")
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    coded = Counter()
    for g, n in found.items():
        coded[code(g)] += n
    return coded


def ranked(counts):
    return sorted(counts, key=lambda g: (-counts[g], g))[:300]


def test_language_by_out_of_place_distance(spark, documents):
    profiles = defaultdict(Counter)
    for d, r in documents.items():
        if zlib.crc32(str(d).encode()) % 4 != 2 and r.lang and r.text is not None:
            profiles[r.lang].update(grams(r.text))
    places = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in profiles.items()}
    for r in queries.op9_language_id(spark, DATA).collect():
        own = ranked(grams(documents[r.doc_id].text or ""))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not any(own):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        away = {lang: sum(abs(i - p[g]) if g in p else 300 for i, g in enumerate(own)) for lang, p in places.items()}
        best = min(sorted(away), key=away.get)
        assert r.lang_pred == best and abs(r.score - (1 - away[best] / (300 * len(own)))) < 1e-9


def test_language_of_odd_rows(spark, odd_folder):
    folder, texts = odd_folder
    rows = queries.op9_language_id(spark, folder).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in texts)
    assert all(isinstance(r.held_out, bool) for r in rows)
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in (1, 2, 3))


def test_every_language_has_a_profile_in_a_bounded_sample(spark):
    """A sample of 200 rows of 4,000 holds all of a rare language, and hundreds of languages are told apart."""
    rows = [(i, f"common{i % 7} words of many rows", "x") for i in range(4000)] + [(5000 + i, "zzz qqq vvv", "rare") for i in range(5)]
    profiles = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), documents=200)
    assert profiles.languages == ["rare", "x"] and profiles.predict("zzz qqq")[0] == "rare"
    rows = [(i, 3 * (chr(0x4E00 + 3 * i) + chr(0x4E01 + 3 * i)), f"lang{i:03}") for i in range(300)]
    profiles = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(profiles.languages) == 300
    assert all(profiles.predict(text)[0] == lang for _, text, lang in rows)
