"""Removal of passages that documents share, by a log-structured index of window fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixfield.llm.batches import slices
from mixfield.llm.common import fresh, written
from mixfield.operators.storage import discard, sorted_table

#: A window has so many words.
WINDOW = 50
#: Windows are grouped by the smallest hash among their runs of so many words.
GRAM = 20
#: Before a batch is added to so many runs, they are merged into one.
FAN_IN = 2
#: Documents go through the index in so many batches.
BATCHES = 3
#: Size in bits of the bitmaps that thin out rows before a join; a set bit too many costs time only.
BITMAP = 1 << 25
#: Multiplier of the polynomial hash, odd.
BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of a base and of its inverse modulo 2 ** 64, made longer when needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            more = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, more, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, more, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers(BASE)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


class Words:
    """A text's words, and hashes of runs of them."""

    def __init__(self, text: bytes):
        self.words = text.split()
        self.n = len(self.words)

    def grams(self, size: int) -> np.ndarray:
        """A hash of each run of ``size`` words."""
        from xxhash import xxh64_intdigest

        up, down = _POWERS.get(self.n + 1)
        hashes = np.fromiter(map(xxh64_intdigest, self.words), np.uint64, self.n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: self.n], dtype=np.uint64)])
        starts = np.arange(self.n - size + 1)
        return _mixed((sums[starts + size] - sums[starts]) * down[starts])

    def digests(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """128 bits of a cryptographic hash of the words of each run, as two numbers."""
        words = self.words
        found = b"".join([blake2b(b" ".join(words[a : a + n]), digest_size=16).digest() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)])
        return np.frombuffer(found, "<i8").reshape(-1, 2)

    def blocks(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``anchor, lo, n``: the text's windows, put together where the same place in the text is their anchor.

        A window's anchor is the run of ``gram`` words with the smallest hash in it, the first of equal ones, so equal windows have equal
        anchors. The ``n`` windows from ``lo`` on share one.
        """
        if self.n < window:
            nothing = np.zeros(0, np.int64)
            return nothing, nothing, nothing
        grams = self.grams(gram)
        windows = self.n - window + 1
        anchors = np.arange(windows)
        for a in range(0, windows, 1 << 16):
            part = grams[a : a + (1 << 16) + window - gram]
            anchors[a : a + (1 << 16)] += np.lib.stride_tricks.sliding_window_view(part, window - gram + 1).argmin(axis=1)
        lo = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
        return grams[anchors[lo]].view(np.int64), lo, np.diff(np.append(lo, windows))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """``d, key, text``: the place of a document in the order of doc_id, null last, and a hash that tells texts of one doc_id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text", F.length("text")).alias("key"), F.col("text").cast("binary").alias("text"), *more)


def _scan(rows: DataFrame, emit, schema: str) -> DataFrame:
    """Rows that ``emit(row, Words)`` gives as columns of numpy arrays for each of ``rows(text, ...)`` with a text."""
    names = [x.split()[0] for x in schema.split(", ")]
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            found = [c for row in batch.to_pylist() if row["text"] and len((c := emit(row, Words(row["text"])))[0])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names)

    return rows.mapInArrow(run, schema)


def bitmap(values: DataFrame) -> DataFrame:
    """``slot, bits``: a bitmap of BITMAP bits in which the low bits of each number of the only column of ``values`` are set; BITMAP / 4096 rows at most."""
    low = values.select(F.col(values.columns[0]).bitwiseAND(F.lit(BITMAP - 1)).alias("x"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(F.lit(63)).cast("int"))
    words = low.groupBy(F.shiftright("x", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    pairs = words.groupBy(F.shiftright("word", 6).alias("slot")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(63)).cast("int"), "bits"))).alias("of"))  # 64 at most
    return pairs.select("slot", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0).cast("long"))).alias("bits"))


def thinned(rows: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """The rows whose number in ``column`` may be in a ``bitmap``, without a shuffle: the bitmap has a bounded size."""
    names, (slot, words) = rows.columns, fresh(rows, "slot", "bits")
    return rows.join(F.broadcast(bits.toDF(slot, words)), _slot(column) == F.col(slot)).where(_bit(column, words) == 1).select(*names)


def others(rows: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """The rows that ``thinned`` leaves out."""
    names, (slot, words) = rows.columns, fresh(rows, "slot", "bits")
    return rows.join(F.broadcast(bits.toDF(slot, words)), _slot(column) == F.col(slot), "left").where(F.coalesce(_bit(column, words), F.lit(0)) == 0).select(*names)


def _slot(column: str) -> Column:
    return F.shiftright(F.col(column).bitwiseAND(F.lit(BITMAP - 1)), 12)


def _bit(column: str, words: str) -> Column:
    low = F.col(column).bitwiseAND(F.lit(BITMAP - 1))
    word = F.get(words, F.shiftright(low, 6).bitwiseAND(F.lit(63)).cast("int"))
    return F.call_function("shiftrightunsigned", word, low.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))


@contextmanager
def _sorted_scans(spark: SparkSession):
    """Scans of bucketed tables keep the order of their one file, so that joins of runs needn't sort them again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Index:
    """Fingerprints of the windows of all batches so far, in sorted runs that are never changed.

    A run has two tables, dealt into buckets by their key and sorted in them: ``blocks`` has a row for each block of windows (see
    ``Words.blocks``), by a digest of its words, with its anchor and the smallest doc_id that has it; ``anchors`` has the smallest doc_id of each anchor. The
    rows of a batch are put into the same buckets and merge-joined with each run. Batches are to be added in rising order of doc_id.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, fan_in: int = FAN_IN, buckets: int | None = None):
        if not 0 < gram <= window:
            raise ValueError("a gram has at least one word and no more than a window")
        self.spark, self.window, self.gram, self.fan_in = spark, window, gram, fan_in
        # as many as partitions of a shuffle, so that sums are written where they are made
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[DataFrame, DataFrame]] = []
        self.batches: list[DataFrame] = []

    def compact(self) -> None:
        """Merges all runs into one; runs of equal buckets are merged bucket by bucket."""
        if len(self.runs) < 2:
            return
        with _sorted_scans(self.spark):

            def merged(tables: list[DataFrame], key: list[str], *other: str) -> DataFrame:
                def two(a: DataFrame, b: DataFrame) -> DataFrame:
                    b = b.select(*key, *(F.col(c).alias(f"_{c}") for c in other))
                    # the older run has the smaller doc_id
                    return a.join(b, key, "full").select(*key, *(F.coalesce(c, f"_{c}").alias(c) for c in other))

                return sorted_table(reduce(two, tables), "run", self.buckets, *key)

            new = merged([r[0] for r in self.runs], ["b1", "b2"], "anchor", "d"), merged([r[1] for r in self.runs], ["anchor"], "d")
        self.close()
        self.runs = [new]

    def close(self) -> None:
        """Deletes the runs' tables."""
        for run in self.runs:
            discard(*run)
        self.runs = []

    def _with_old(self, rows: DataFrame, which: int, *key: str) -> DataFrame:
        """``rows`` with ``old``: the smallest doc_id that the runs have for their key, null if none has it."""
        for i, run in enumerate(self.runs):
            rows = rows.join(run[which].select(*key, F.col("d").alias(f"old{i}")), list(key), "left")
        old = F.coalesce(*(F.col(f"old{i}") for i in range(len(self.runs)))) if self.runs else F.lit(None).cast("long")
        return rows.withColumn("old", old).drop(*(f"old{i}" for i in range(len(self.runs))))

    def add(self, batch: DataFrame) -> DataFrame:
        """``d, key, start, n``: the spans of words of ``batch(doc_id, text)`` that an earlier document's windows cover.

        Earlier is a smaller doc_id, of this batch or one before; spans may overlap. A block is covered if an earlier document has a block
        with the same digest. Where blocks of one anchor differ, and one of them is new, their windows are compared by
        digests; only for these are texts of earlier batches read, of one document for each block.
        """
        window, gram = self.window, self.gram
        if len(self.runs) >= self.fan_in:
            self.compact()

        def blocks(row: dict, words: Words):
            anchor, lo, n = words.blocks(window, gram)
            b = words.digests(lo, n + (window - 1))
            return anchor, b[:, 0], b[:, 1], np.full(len(lo), row["d"], np.int64), np.full(len(lo), row["key"], np.int64), lo.astype(np.int32), n.astype(np.int32)

        found = written(_scan(_keyed(batch), blocks, "anchor long, b1 long, b2 long, d long, key long, lo int, n int"), "blocks")
        self.batches.append(batch.select("doc_id", "text"))
        with _sorted_scans(self.spark):
            own = found.groupBy("b1", "b2").agg(F.min("anchor").alias("anchor"), F.min("d").alias("d"), F.max("d").alias("most"))
            own = sorted_table(own, "own", self.buckets, "b1", "b2")
            known = written(self._with_old(own, 0, "b1", "b2").where("old is not null or d < most").select("b1", "b2", F.least("old", "d").alias("first"), F.col("old").isNotNull().alias("is_old")), "known")
            # this batch's run has what no run before has
            new = own
            if self.runs:
                new = sorted_table(own.join(known.where("is_old").select("b1", "b2"), ["b1", "b2"], "left_anti").select("b1", "b2", "anchor", "d"), "run", self.buckets, "b1", "b2")
            anchors = sorted_table(new.groupBy("anchor").agg(F.min("d").alias("d"), F.max("d").alias("most")), "run", self.buckets, "anchor")
            touched = self._with_old(anchors, 1, "anchor").select("anchor", F.least("old", "d").alias("least"), "most").where("least < most")
            touched = written(touched, "touched")
        joined = thinned(found, "b1", bitmap(known.select("b1"))).join(known.select("b1", "b2", "first"), ["b1", "b2"]).where("first < d")
        spans = written(joined.select("d", "key", F.col("lo").alias("start"), (F.col("n") + (window - 1)).alias("n")), "covered")
        low = found.agg(F.min("d")).first()[0]
        if not touched.isEmpty():
            spans = spans.union(self._by_window(new, touched, low))
        self.runs.append((new, anchors))
        discard(found, known, touched, *[own] * (own is not new))
        return spans

    def _by_window(self, new: DataFrame, touched: DataFrame, low: int) -> DataFrame:
        """Spans of single windows: of the new blocks of anchors that an earlier document has, in a block that differs."""
        window, gram = self.window, self.gram
        bits = bitmap(touched.select("anchor"))
        every = reduce(DataFrame.union, [r.select("anchor", "b1", "d") for r in (new, *(run[0] for run in self.runs))])
        # a new block after the first document of its anchor, or any block before the last new one
        wanted = thinned(every, "anchor", bits).join(touched, "anchor").where(((F.col("d") >= F.lit(low)) & (F.col("d") > F.col("least"))) | (F.col("d") < F.col("most")))
        wanted = written(wanted.groupBy("d").agg(F.collect_set("b1").alias("wanted")), "wanted")  # as many as a document has blocks
        texts = thinned(_keyed(reduce(DataFrame.union, self.batches)), "d", bitmap(wanted.select("d"))).join(wanted, "d")

        def windows(row: dict, words: Words):
            _, lo, n = words.blocks(window, gram)
            keep = np.isin(words.digests(lo, n + (window - 1))[:, 0], np.array(row["wanted"], np.int64))
            lo, n = lo[keep], n[keep]
            starts = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) if len(lo) else lo
            w = words.digests(starts, np.full(len(starts), window))
            return w[:, 0], w[:, 1], np.full(len(starts), row["d"], np.int64), np.full(len(starts), row["key"], np.int64), starts.astype(np.int32)

        opened = written(_scan(texts, windows, "w1 long, w2 long, d long, key long, start int"), "windows")
        earliest = opened.groupBy("w1", "w2").agg(F.min("d").alias("first"), F.max("d").alias("most")).where("first < most").select("w1", "w2", "first")
        earliest = written(earliest, "earliest")
        mine = thinned(opened.where(F.col("d") >= F.lit(low)), "w1", bitmap(earliest.select("w1")))
        found = written(mine.join(earliest, ["w1", "w2"]).where("first < d").select("d", "key", "start", F.lit(window).alias("n")), "by-window")
        discard(wanted, opened, earliest)
        return found


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row of ``docs(doc_id, text)``.

    ``kept`` has the words of the whole text, joined by spaces, without those covered by a window of ``window`` words that also starts in
    a document of a smaller doc_id. The documents go through an ``Index`` in ``batches`` ranges of doc_id; the result doesn't depend on their number.
    Texts are compared as they are in ``docs``, not as they are after a removal. A null or empty text has no words. A null doc_id is larger
    than all others; rows of equal doc_id are not earlier than one another. Other columns are dropped.
    """
    index = Index(docs.sparkSession, window, gram)
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    edges = [None, *map(int, cuts), None]
    spans = []
    for low, high in zip(edges, edges[1:], strict=False):
        inside = F.lit(True) if low is None else F.coalesce(F.col("doc_id") > low, F.lit(True))
        inside = inside if high is None else inside & F.coalesce(F.col("doc_id") <= high, F.lit(False))
        spans.append(index.add(docs.where(inside)))
    index.close()
    removed = reduce(DataFrame.union, spans).groupBy("d", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("lengths"))
    rows = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).join(removed, ["d", "key"], "left").select("doc_id", "text", "starts", "lengths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            spans = ([None if x is None else np.array(x, np.int64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            out = list(map(_without, batch.column(1).to_pylist(), *spans))
            counts, gone, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _without(text: bytes | None, starts: np.ndarray | None, lengths: np.ndarray | None) -> tuple[int, int, bytes]:
    words = text.split() if text else []
    if starts is None:
        return len(words), 0, b" ".join(words)
    edges = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + lengths, minlength=len(words) + 1)
    keep = np.cumsum(edges[: len(words)]) == 0
    return len(words), int(len(words) - keep.sum()), b" ".join([w for w, k in zip(words, keep, strict=True) if k])
