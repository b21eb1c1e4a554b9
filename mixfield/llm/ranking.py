"""Ranked lexical search: posting lists in geometric blocks with coordinatewise-maximum summaries, skipped only where exact bounds allow it."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixfield.llm.batches import slices
from mixfield.llm.common import written
from mixfield.operators.order import numbered
from mixfield.operators.storage import discard

#: So many documents are returned for an item.
TOP = 10
#: Items go through the index in batches of so many, and so many different terms, at most.
ITEMS, VOCABULARY = 1024, 8192
#: The rarest terms of an item, with about so many postings, are scored first; the TOP-th score found is what blocks have to reach.
SEEDS = 4096
#: A posting list is cut into shards of so many documents, and these into blocks of about BLOCK similar documents.
SHARD, BLOCK = 2048, 12
#: What terms are made of, as a table for bytes; all else becomes a blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


@dataclass
class Batch:
    """Items of one batch: their terms' numbers in ``vocabulary`` and how often each occurs in them."""

    keys: list[int]
    items: list[dict[bytes, int]]
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*self.items)))}
        self.terms = [np.array([self.vocabulary[t] for t in x], np.int64) for x in self.items]
        self.times = [np.array(list(x.values()), np.int64) for x in self.items]

    def halves(self) -> list[Batch]:
        """The batch in parts with at most VOCABULARY terms each; an item with more is a part of its own."""
        if len(self.vocabulary) <= VOCABULARY or len(self.keys) == 1:
            return [self]
        half = len(self.keys) // 2
        return [x for part in (slice(None, half), slice(half, None)) for x in Batch(self.keys[part], self.items[part]).halves()]


def batches_of(items: DataFrame, size: int = ITEMS) -> Iterator[Batch]:
    """The rows of ``items(q, text)``, whose ``q`` counts from 0, in batches that are brought to the driver one after another."""
    for low in range(0, items.count(), size):
        rows = sorted(items.where((F.col("q") >= low) & (F.col("q") < low + size)).select("q", F.col("text").cast("binary")).collect(), key=lambda r: r.q)
        yield from Batch([r.q for r in rows], [Counter(terms_of(r.text)) for r in rows]).halves()


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``d, doc_id, n, terms, times``: the number of terms of each whole text of ``docs(doc_id, text)`` with any, and those of the vocabulary with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # VOCABULARY terms, or those of one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, 2):
            n, terms, times = [], [], []
            for text in batch.column(2).to_pylist():
                words = terms_of(text)
                n.append(len(words))
                found = Counter(filter(known.__contains__, words))
                order = sorted((known[t], k) for t, k in found.items())
                terms.append([t for t, _ in order])
                times.append([k for _, k in order])
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["d", "doc_id", "n", "terms", "times"])
            yield rows.filter(pa.array([x > 0 for x in n], pa.bool_()))

    rows = docs.select(F.monotonically_increasing_id().alias("d"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "d long, doc_id long, n long, terms array<int>, times array<long>")


def exact(f, *arrays: np.ndarray) -> np.ndarray:
    """``f`` of whole numbers as Python's, which have no bound."""
    return np.array([f(*map(int, x)) for x in zip(*arrays, strict=True)], np.int64)


@dataclass
class Scoring:
    """What scores need besides a document: counts of the corpus, and for each term its weight and the largest impact that it has anywhere."""

    documents: int
    length: int
    weights: np.ndarray | None = None
    largest: np.ndarray | None = None

    def impacts(self, n: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The impact of each posting, for documents of ``n`` terms with ``sizes`` postings each."""
        if len(n) and 75 * int(n.max()) * self.documents < 1 << 62:
            m = 25 + 75 * n * self.documents // self.length
        else:
            m = exact(lambda x: 25 + 75 * x * self.documents // self.length, n)
        m = np.repeat(m, sizes)
        if len(times) and max(int(times.max()), int(m.max())) < 1 << 32:
            return 1_000_000_000 * times // (1000 * times + 8 * m)
        return exact(lambda t, x: 1_000_000_000 * t // (1000 * t + 8 * x), times, m)


class Shard:
    """Some documents of the forward index, as one table of impacts by document and term."""

    def __init__(self, batch: pa.RecordBatch, scoring: Scoring, width: int):
        self.d, self.doc_id = batch.column(0).to_numpy(), batch.column(1)
        offsets = batch.column(3).offsets.to_numpy()
        self.sizes = np.diff(offsets)
        self.terms = batch.column(3).flatten().to_numpy()
        self.row = np.repeat(np.arange(len(self.d)), self.sizes)
        self.impact = scoring.impacts(batch.column(2).to_numpy(), batch.column(4).flatten().to_numpy(), self.sizes)
        self.table = np.zeros((len(self.d), width), np.int32)  # an impact is below 10 ** 6
        self.table[self.row, self.terms] = self.impact
        order = np.argsort(self.terms, kind="stable")
        self.by_term = self.row[order]
        self.starts = np.searchsorted(self.terms[order], np.arange(width + 1))

    def having(self, term: int) -> np.ndarray:
        """The rows of the documents in a term's list."""
        return self.by_term[self.starts[term] : self.starts[term + 1]]

    def scores(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.table[rows][:, terms].astype(np.int64) @ weights


def shards(batches: Iterator[pa.RecordBatch], scoring: Scoring, width: int, extra: bool = False) -> Iterator:
    """``Shard`` objects of the forward index; their tables have 16 million cells at most, or 64 documents. With ``extra``, each comes with its rows."""
    most = max(64, min(SHARD, (1 << 24) // max(width, 1)))
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(a, most).columns], schema=batch.schema)
            shard = Shard(part, scoring, width)
            yield (shard, part) if extra else shard


RESULT = "q long, d long, doc_id long, score long"


class _Best:
    """The best documents of each item so far."""

    def __init__(self, keys: list[int], top: int):
        self.keys, self.top, self.found = keys, top, {}

    def add(self, item: int, shard: Shard, rows: np.ndarray, scores: np.ndarray) -> None:
        keep = scores > 0
        if item in self.found and len(self.found[item]) >= self.top:
            keep &= scores >= self.found[item][-1][0]
        rows, scores = rows[keep], scores[keep]
        if len(rows):
            new = [(s, x is None, x or 0, d) for s, x, d in zip(scores.tolist(), shard.doc_id.take(pa.array(rows)).to_pylist(), shard.d[rows].tolist(), strict=True)]
            self.found[item] = sorted(self.found.get(item, []) + new, key=lambda r: (-r[0], *r[1:]))[: self.top]

    def batch(self) -> pa.RecordBatch:
        rows = [(self.keys[i], d, None if null else x, s) for i, found in self.found.items() for s, null, x, d in found]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["q", "d", "doc_id", "score"])


def first(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each ``q`` by score, ties by doc_id, null last, with ``rank``; in two steps, so that the rows of an item don't meet in one task first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("d")]
    part = rows.withColumn("part", F.pmod(F.xxhash64("d"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= top)


def list_statistics(forward: DataFrame, scoring: Scoring, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each term the number of documents that have it and the largest impact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, largest = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            terms = batch.column(3).flatten().to_numpy()
            count += np.bincount(terms, minlength=width)
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            np.maximum.at(largest, terms, scoring.impacts(batch.column(2).to_numpy(), batch.column(4).flatten().to_numpy(), sizes))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), pa.array(largest[at])], ["term", "df", "largest"])

    found = forward.mapInArrow(run, "term long, df long, largest long").groupBy("term").agg(F.sum("df").alias("df"), F.max("largest").alias("largest")).toArrow()
    df, largest = np.zeros(width, np.int64), np.zeros(width, np.int64)
    at = found.column("term").to_numpy()
    df[at], largest[at] = found.column("df").to_numpy(), found.column("largest").to_numpy()
    return df, largest


def blocks_of(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of ``x`` in groups of about ``size``, by the nearest of as many evenly spaced rows in direction; a group of more than twice the size is cut."""
    if len(x) <= size:
        return [np.arange(len(x))]
    unit = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)
    near = (unit @ unit[::size].T).argmax(axis=1)
    order = np.argsort(near, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(near[order])) + 1)
    return [g[a : a + 2 * size] for g in groups for a in range(0, len(g), 2 * size)]


def build_blocks(forward: DataFrame, scoring: Scoring, width: int, needed: dict[int, np.ndarray], block: int = BLOCK) -> DataFrame:
    """The index ``term, docs, coordinates, largest``: blocks of similar documents of the lists ``needed``, which name the terms that may occur together with each in an item.

    A block's summary has the largest impact of any of its documents for each of these terms; terms that none of them has are left out.
    """
    shared = forward.sparkSession.sparkContext.broadcast((scoring, needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scoring, needed = shared.value
        for shard in shards(batches, scoring, width):
            terms, docs, coordinates, largest = [], [], [], []
            for term in np.unique(shard.terms).tolist():
                own = needed.get(term)
                if own is None:
                    continue
                rows = shard.having(term)
                part = shard.table[rows][:, own]
                for group in blocks_of(part * scoring.weights[own].astype(np.float32), block):
                    most = part[group].max(axis=0)
                    at = np.flatnonzero(most)
                    terms.append(term)
                    docs.append(shard.d[rows[group]])
                    coordinates.append(own[at])
                    largest.append(most[at])
            if terms:
                lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(np.concatenate(parts).astype(kind)))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), lists(docs, np.int64), lists(coordinates, np.int32), lists(largest, np.int32)], ["term", "docs", "coordinates", "largest"])

    return forward.mapInArrow(run, "term int, docs array<long>, coordinates array<int>, largest array<int>")


def visits(index: DataFrame, batch: Batch, scoring: Scoring, lists: list[np.ndarray], reached: np.ndarray) -> DataFrame:
    """``d, qs``: the documents of all blocks whose summary allows a score of ``reached`` or more for an item that needs the block's list, and these items' places."""
    width = len(batch.vocabulary)
    wanting: dict[int, list[int]] = {}
    for i, terms in enumerate(lists):
        for t in terms.tolist():
            wanting.setdefault(t, []).append(i)
    weights = np.zeros((len(batch.keys), width), np.int64)
    for i, (terms, times) in enumerate(zip(batch.terms, batch.times, strict=True)):
        weights[i, terms] = scoring.weights[terms] * times
    shared = index.sparkSession.sparkContext.broadcast((wanting, weights, reached))  # ITEMS * VOCABULARY numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanting, weights, reached = shared.value
        for rows in batches:
            for a in range(0, rows.num_rows, 1024):
                part = rows.slice(a, 1024)
                items = [wanting.get(t, ()) for t in part.column(0).to_pylist()]
                pairs = np.array([len(x) for x in items])
                item, of = np.array([i for x in items for i in x], np.int64), np.repeat(np.arange(len(items)), pairs)
                ends = part.column(2).offsets.to_numpy()
                ends, starts = ends[1:] - ends[0], ends[:-1] - ends[0]
                some = (ends > starts)[of]
                item, of = item[some], of[some]
                n = (ends - starts)[of]
                at = np.repeat(starts[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                coordinates, largest = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                parts = weights[np.repeat(item, n), coordinates[at]] * largest[at]
                bound = np.add.reduceat(parts, np.cumsum(n) - n) if len(n) else np.zeros(0, np.int64)
                keep = np.flatnonzero(bound >= reached[item])
                docs = part.column(1)
                found = [docs[k].values.to_numpy() for k in of[keep].tolist()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(item[keep], [len(x) for x in found]).astype(np.int32))], ["d", "item"])

    return index.mapInArrow(run, "d long, item int").groupBy("d").agg(F.collect_set("item").alias("qs"))  # ITEMS at most


def _ranked(docs: DataFrame, batch: Batch, counts: tuple[int, int] | None, top: int, seeds: int, block: int) -> tuple[DataFrame, tuple[int, int]]:
    """The best documents of the items of one batch: ``q, d, doc_id, score, rank``; and the counts of the corpus."""
    width = len(batch.vocabulary)
    forward = written(forward_index(docs, batch.vocabulary), "forward")
    if counts is None:
        row = forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
        counts = row["n"], row["all"]
    scoring = Scoring(*counts)
    df, scoring.largest = list_statistics(forward, scoring, width)
    scoring.weights = np.array([math.floor(1000 * math.log((2 * scoring.documents + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
    weights = [scoring.weights[t] * k for t, k in zip(batch.terms, batch.times, strict=True)]

    rarest = []
    for terms in batch.terms:
        terms = terms[df[terms] > 0]
        terms = terms[np.argsort(df[terms], kind="stable")]
        upto = np.cumsum(df[terms])
        rarest.append(terms[: int(np.searchsorted(upto, seeds)) + 1])
    shared = docs.sparkSession.sparkContext.broadcast((scoring, batch.keys, batch.terms, weights, rarest))

    def seeded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scoring, keys, terms, weights, rarest = shared.value
        best = _Best(keys, top)
        for shard in shards(rows, scoring, width):
            for i, own in enumerate(rarest):
                lists = [shard.having(t) for t in own.tolist()]
                found = np.unique(np.concatenate(lists)) if lists else ()
                if len(found):
                    best.add(i, shard, found, shard.scores(found, terms[i], weights[i]))
        yield best.batch()

    begun = written(first(forward.mapInArrow(seeded, RESULT), top).drop("rank"), "seeded")
    least = {r["q"]: r["score"] for r in begun.groupBy("q").agg(F.count("*").alias("k"), F.min("score").alias("score")).where(F.col("k") >= top).collect()}
    reached = np.array([least.get(q, 1) for q in batch.keys], np.int64)
    # documents with any of the rarest terms are scored; of the other lists, the least ones that together can't reach the score are not needed
    lists = []
    for i, terms in enumerate(batch.terms):
        keep = (df[terms] > 0) & ~np.isin(terms, rarest[i])
        own, most = terms[keep], (weights[i] * scoring.largest[terms])[keep]
        order = np.argsort(most, kind="stable")
        lists.append(own[order][np.cumsum(most[order]) >= reached[i]])
    together: dict[int, set[int]] = {}
    for own, terms in zip(lists, batch.terms, strict=True):
        for t in own.tolist():
            together.setdefault(t, set()).update(terms.tolist())
    needed = {t: np.array(sorted(x), np.int64) for t, x in together.items()}
    if not needed:
        return first(begun, top), counts
    index = written(build_blocks(forward, scoring, width, needed, block), "blocks")
    visited = written(visits(index, batch, scoring, lists, reached), "visits")

    def scored(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scoring, keys, terms, weights, _ = shared.value
        best = _Best(keys, top)
        for shard, part in shards(rows, scoring, width, extra=True):
            row = np.repeat(np.arange(part.num_rows), np.diff(part.column(5).offsets.to_numpy()))
            item = part.column(5).flatten().to_numpy()
            order = np.argsort(item, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else ():
                i, found = int(item[group[0]]), row[group]
                best.add(i, shard, found, shard.scores(found, terms[i], weights[i]))
        yield best.batch()

    more = forward.join(visited, "d").select("d", "doc_id", "n", "terms", "times", "qs").mapInArrow(scored, RESULT)
    out = written(first(begun.union(more).distinct(), top), "ranked")
    discard(index, visited, forward)
    return out, counts


def search(docs: DataFrame, items: DataFrame, top: int = TOP, size: int = ITEMS, seeds: int = SEEDS, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of ``docs(doc_id, text)`` with the highest scores above 0 for each row of ``items(item_id, text)``.

    Items go through the index in batches, whose vocabulary is all that the index has. The documents of an item's rarest terms are scored first. The ``top``-th of these scores is what any
    further document has to reach: lists whose largest impacts don't add up to it are left out, and the others are read block by block. A block has
    similar documents of one list and the largest impact of each term in them, and is skipped if and only if these don't add up to the score. What is left is scored exactly, so
    the result is that of scoring all documents. Ties go to the smaller doc_id, null last, and then to the row that comes first. A null or empty text has no
    terms; documents without terms count nowhere. Repeated items each get their rows, and so do repeated documents. Other columns are dropped.
    """
    spark = docs.sparkSession
    items = written(numbered(items.select("item_id", F.col("text").cast("string").alias("text")), "q", "item_id", "text"), "items")
    out, counts = spark.createDataFrame([], f"{RESULT}, rank int"), None
    for batch in batches_of(items, size):
        if batch.vocabulary:
            found, counts = _ranked(docs, batch, counts, top, seeds, block)
            out = out.unionByName(found)
    return out.join(items.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
