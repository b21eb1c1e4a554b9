"""Toxicity grades by cumulative-link (proportional-odds) ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixfield.llm.batches import slices
from mixfield.llm.common import smallest, written

#: At most so many labelled documents, those with the smallest hash of doc_id, fit the model.
FIT_DOCUMENTS = 8000
#: Features are hashed to so many buckets.
BUCKETS = 1 << 22
#: A feature is kept if so many toxic documents of the sample have it, and so many times the share that is expected.
SUPPORT, LIFT = 3, 4.0
GRADES = 3
_WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Buckets of a word in lower case: the word itself and its beginnings of four to six letters."""
    return [crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n))]


def text_features(text: str) -> np.ndarray:
    """The distinct buckets of a text."""
    return np.unique(np.array([b for w in set(_WORD.findall(text.lower())) for b in features(w)], np.int64))


@dataclass(frozen=True)
class Model:
    """``P(grade > k) = sigmoid(sum of weights - thresholds[k])``: one weight for a feature, whatever the threshold."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def severity(self, present: set[int]) -> float:
        score = sum(self.weights[x] for x in sorted(present))
        return float(sum(1 / (1 + np.exp(min(t - score, 500.0))) for t in self.thresholds))


def telling(with_any, with_bad, n: int, bad: int):
    """Which features are kept, from the numbers of documents, and of toxic ones, that have them; for arrays and for columns."""
    share = bad / max(n, 1)
    return (with_bad >= SUPPORT) & (with_bad > min(LIFT * share, 0.5) * with_any) & (with_bad > with_any * share + 3 * (with_any * share) ** 0.5)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def loss(score: np.ndarray, thresholds: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean of -ln P(grade) and its slopes by each score and each threshold.

    ``P(grade = k) = P(grade > k - 1) - P(grade > k)``: the probability of the interval between two thresholds, the outer ones infinite.
    """
    n = len(score)
    above = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] - thresholds), np.zeros((n, 1))], axis=1)
    row = np.arange(n)
    low, high = above[row, grade], above[row, grade + 1]
    p = np.maximum(low - high, 1e-300)
    by_threshold = np.zeros(len(thresholds))
    for k in range(len(thresholds)):
        by_threshold[k] = (low * (1 - low) / p)[grade == k + 1].sum() - (high * (1 - high) / p)[grade == k].sum()
    return float(-np.log(p).mean()), -(1 - low - high) / n, by_threshold / n


class _Sample:
    """Documents as rows of the features kept for a fit."""

    def __init__(self, rows: list[np.ndarray], toxic: np.ndarray):
        self.n, bad = len(rows), int(toxic.sum())
        buckets, at = (np.concatenate(rows).astype(np.int64), np.repeat(np.arange(self.n), [len(r) for r in rows])) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        known, column = np.unique(buckets, return_inverse=True)
        with_any, with_bad = np.bincount(column, minlength=len(known)), np.bincount(column, toxic[at], len(known))
        keep = telling(with_any, with_bad, self.n, bad) if len(known) else np.zeros(0, bool)
        self.kept = known[keep]
        place = np.cumsum(keep) - 1
        self.at, self.columns = at[keep[column]], place[column[keep[column]]]

    def fit(self, grade: np.ndarray, steps: int, rate: float, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """Weights and thresholds that make the grades likely; the distance of two thresholds is fitted by its logarithm."""
        weights = np.zeros(len(self.kept))
        first, gaps = 2.0, np.zeros(int(grade.max()) - 1)
        seen = [np.full(len(self.kept), 1e-8), 1e-8, np.full(len(gaps), 1e-8)]
        for _ in range(steps):
            thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            _, by_score, by_threshold = loss(np.bincount(self.at, weights[self.columns], self.n), thresholds, grade)
            after = np.cumsum(by_threshold[::-1])[::-1]  # a gap moves all thresholds after it
            slopes = [np.bincount(self.columns, by_score[self.at], len(self.kept)) + penalty * weights, after[0], after[1:] * np.exp(gaps)]
            seen = [s + g * g for s, g in zip(seen, slopes, strict=True)]
            weights, first, gaps = (x - rate * g / np.sqrt(s) for x, g, s in zip((weights, first, gaps), slopes, seen, strict=True))
        return weights, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def severity_order(rows: list[np.ndarray], toxic: np.ndarray, fold: np.ndarray, steps: int = 1000) -> np.ndarray:
    """Grades 0, 1 and 2 of documents that are only known as toxic or not.

    A binary model of the other fold's documents scores the toxic documents of each fold; those above their median have grade 2. So no
    grade is read off a model, or features chosen, with the help of the document itself.
    """
    grade = (toxic == 1).astype(np.int64)
    for own in (0, 1):
        there, here = np.flatnonzero(fold != own), np.flatnonzero((fold == own) & (toxic == 1))
        if not len(here) or not 0 < toxic[there].sum() < len(there):
            continue
        other = _Sample([rows[i] for i in there], toxic[there])
        weights, _ = other.fit((toxic[there] == 1).astype(np.int64), steps, 0.5, 1e-5)
        known = dict(zip(other.kept.tolist(), weights.tolist(), strict=True))
        score = np.array([sum(known.get(b, 0.0) for b in rows[i].tolist()) for i in here])
        grade[here] += score > np.median(score)
    return grade


def train(rows: list[np.ndarray], toxic: np.ndarray, fold: np.ndarray | None = None, steps: int = 4000, rate: float = 0.5, penalty: float = 1e-5) -> Model:
    """Fits the model to documents given as arrays of distinct buckets, by the likelihood of their grades (``severity_order``).

    Without documents of both kinds nothing is toxic. ``fold`` has two values, by default by a hash of a row's place.
    """
    n, bad = len(rows), int(toxic.sum())
    if not n or not bad or bad == n:
        return Model({}, tuple(50.0 + k for k in range(GRADES - 1)))
    fold = (np.arange(n) * 2654435761 >> 16) & 1 if fold is None else fold
    grade = severity_order(rows, toxic, fold)
    if grade.max() < GRADES - 1:  # too few toxic documents to be ordered
        grade[np.flatnonzero(toxic == 1)[-1]] = GRADES - 1
    sample = _Sample(rows, toxic)
    weights, thresholds = sample.fit(grade, steps, rate, penalty)
    return Model({int(b): float(w) for b, w in zip(sample.kept, weights, strict=True)}, tuple(map(float, thresholds)))


def fit(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    The sample has at most ``documents`` labelled documents. Spark counts which features may be kept, and of each document only those reach the
    driver. Rows with a null doc_id, text or label are left out, as are doc_ids labelled both ways; a doc_id with several labels
    counts once, and of several texts the one with the smallest hash counts.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    sample = smallest(known, documents, "doc_id").select("doc_id", "toxic")
    # at most ``documents`` rows of two numbers: small enough to send to all tasks, so only the sample's texts are shuffled
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").cast("int").alias("toxic"))
    rows = written(rows.select("doc_id", "text", "toxic", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)).cast("int").alias("fold")), "sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [text_features(t) for t in batch.column(1).to_pylist()]
            n = [len(f) for f in found]
            toxic, fold = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), n) for k in (2, 3))
            buckets, at = np.unique(np.concatenate(found), return_inverse=True)
            sums = [np.bincount(at, w, len(buckets)).astype(np.int64) for w in (fold == 0, fold == 1, (fold == 0) * toxic, (fold == 1) * toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets), *map(pa.array, sums)], ["bucket", "any0", "any1", "bad0", "bad1"])

    sums = rows.mapInArrow(counts, "bucket long, any0 long, any1 long, bad0 long, bad1 long").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("any0", "any1", "bad0", "bad1")))
    sizes = {r["fold"]: (r["n"], r["bad"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).collect()}
    (n0, b0), (n1, b1) = sizes.get(0, (0, 0)), sizes.get(1, (0, 0))
    # features that any of the three fits may keep: of either fold, or of both together
    useful = telling(F.col("any0"), F.col("bad0"), n0, b0) | telling(F.col("any1"), F.col("bad1"), n1, b1) | telling(F.col("any0") + F.col("any1"), F.col("bad0") + F.col("bad1"), n0 + n1, b0 + b1)
    kept = np.sort(np.array([r["bucket"] for r in sums.where(useful).select("bucket").collect()], np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(kept)  # BUCKETS numbers at most: 32 MB

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = [np.intersect1d(text_features(t), shared.value, assume_unique=True).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2), batch.column(3)], ["doc_id", "buckets", "toxic", "fold"])

    found = sorted(rows.mapInArrow(chosen, "doc_id long, buckets binary, toxic int, fold int").collect(), key=lambda r: r.doc_id)
    return train([np.frombuffer(r.buckets, "<u4") for r in found], np.array([r.toxic for r in found], np.int64), np.array([r.fold for r in found], np.int64))


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, severity, grade, toxic`` of each whole text of ``docs(doc_id, text)``.

    ``severity`` is the expected grade (0 to 2), ``grade`` the nearest one, and ``toxic`` is severity of at least one half. A
    null or empty text has none of the features. A doc_id may be null or repeated; each row is graded by itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each of BUCKETS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weights = own.weights
        known: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches, 1):
            out = []
            for text in batch.column(1).to_pylist():
                present: set[int] = set()
                for word in set(_WORD.findall(text.lower())) if text else ():
                    hits = known.get(word)
                    if hits is None:
                        hits = tuple(b for b in features(word) if b in weights)
                        if len(known) < 100_000 and len(word) <= 32:
                            known[word] = hits
                    if hits:
                        present.update(hits)
                out.append(own.severity(present))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "severity"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, severity double")
    return scored.select("doc_id", F.round("severity", 9).alias("severity"), F.round("severity").cast("int").alias("grade"), (F.col("severity") >= 0.5).alias("toxic"))
