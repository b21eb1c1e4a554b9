"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixfield.llm.batches import slices
from mixfield.llm.common import written

#: A profile has so many n-grams, and so many of a document's are compared with it.
PROFILE = 300
#: About so many labelled documents, chosen by a hash of their doc_id, make the profiles.
FIT_DOCUMENTS = 20_000


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The 1-, 2- and 3-grams of a text's letters in lower case and how often each occurs.

    What lies between words counts as one separator (code 0), which an n-gram may begin or end with. An n-gram is
    coded by its code points, 21 bits each.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[~_is_letter(points)] = 0
    points = points[np.append((points[1:] != 0) | (points[:-1] != 0), True)]
    inner = points[1:-1] != 0
    grams = np.concatenate([points[points != 0], ((points[:-1] << 21) | points[1:]), ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[inner]])
    return np.unique(grams, return_counts=True)


_LETTERS: np.ndarray | None = None


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS[points]


def most_frequent(grams: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent, ties by code."""
    if len(grams) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:n]]


class Profiles:
    """Ranked n-grams of each language, made ready for comparison with documents."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.languages = sorted(ranked)
        self.size = size
        sizes = np.array([len(ranked[x]) for x in self.languages], np.int64)
        grams = np.concatenate([np.array(ranked[x], np.int64) for x in self.languages]) if ranked else np.zeros(0, np.int64)
        order = np.argsort(grams, kind="stable")
        # by n-gram: the languages that have it, and its ranks there
        self.known, starts = np.unique(grams[order], return_index=True)
        self.starts = np.append(starts, len(grams))
        self.language = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.rank = np.concatenate([np.arange(n) for n in sizes])[order] if ranked else grams

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages:
            return "und", 0.0
        own = most_frequent(*ngram_counts(text), self.size)
        if not len(own) or not own.any():
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        place = np.flatnonzero(self.known[at] == own)
        at = at[place]
        n = self.starts[at + 1] - self.starts[at]
        where = np.repeat(self.starts[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # an n-gram that a profile lacks is as far out of place as can be
        nearer = np.bincount(self.language[where], self.size - np.abs(self.rank[where] - np.repeat(place, n)), len(self.languages))
        away = self.size * len(own) - nearer
        best = int(away.argmin())
        return self.languages[best], 1.0 - float(away[best]) / (self.size * len(own))


def fit(labelled: DataFrame, documents: int = FIT_DOCUMENTS, size: int = PROFILE) -> Profiles:
    """Profiles from ``labelled(doc_id, text, lang)``; rows without text or lang are left out.

    If there are more than ``documents`` rows, those with a small hash of doc_id are taken: of each language the same number in expectation, all of one that has
    fewer, and ``documents`` of all languages at most. Each task sums the n-grams of its
    rows by language, the sums of the tasks are added, and only the ``size`` most frequent of each language reach the driver.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    languages = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n, kinds = languages.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if n > documents:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
        rows = rows.join(languages, "lang").where(place * F.col("n") < documents / kinds).select("doc_id", "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(lang: str) -> None:
            parts = waiting.pop(lang) + ([sums[lang]] if lang in sums else [])
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            sums[lang] = grams, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)

        for batch in slices(batches, 1):
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                waiting.setdefault(lang, []).append(ngram_counts(text))
                if len(waiting[lang]) >= 500:
                    merge(lang)
        for lang in list(waiting):
            merge(lang)
        for lang, (grams, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    ranked: dict[str, list[int]] = {}
    for row in first.orderBy("lang", "rank").collect():  # documents * size rows at most
        ranked.setdefault(row.lang, []).append(row.gram)
    return Profiles(ranked, size)


def identify(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, lang_pred, score`` and the columns ``keep`` of each row of ``docs``, from its whole text.

    The language is the one whose profile is nearest by out-of-place distance to the document's most frequent
    n-grams, ties by name; the score is 1 less the distance as a share of the largest possible one. A null text
    and a text without letters get ``und`` and 0, as does every text if there are no profiles. Only the text is looked at; a
    doc_id may be null or repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # at most FIT_DOCUMENTS * PROFILE ranks
    names = ["doc_id", "text", *keep, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, 1):
            found = [own.predict(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def fold(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, modulo 4: the fold that is held out is 2. Null has no fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that profiles may be learned from: all but fold 2; a null doc_id is not learned from."""
    return docs.where((fold() != 2) & F.col("lang").isNotNull())
