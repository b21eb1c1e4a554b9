"""Near-duplicates by SimHash, found through a grid over per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixfield.llm.batches import slices
from mixfield.llm.common import written
from mixfield.llm.substrings import bitmap, thinned
from mixfield.operators.graph import components
from mixfield.operators.storage import discard

SHINGLE, SEED = 3, 42
#: Fingerprints with at most so many differing bits are linked.
DISTANCE = 2
#: Fingerprints are cut into segments of so many bits; a cell of the grid holds one bit count for each of the 16 segments.
SEGMENT = 4
#: Cells with more fingerprints than this are not paired up but verified through common midpoints, or on texts through a centre.
PAIRED = 8
#: Texts are linked whose sets of so many words in a row have at least this Jaccard similarity.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Each text has fingerprints of so many parts of its shingles at most.
PARTS = 24
#: Texts with at least so many of them are compared only if they have two in common.
MANY = 12


def shingle_hashes(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; of the whole sequence if it has fewer words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []  # of bytes: A-Z only, and ASCII white space only
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(partial(xxh64_intdigest, seed=seed), shingles), "<u8", max(1, len(words) - size + 1))


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit number; 0 without words."""
    if not text or not text.strip():
        return 0
    hashes = shingle_hashes(text, size, seed)
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` for each row of ``docs(doc_id, text)``, from the whole text; 0 if it has no words or is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [fingerprint(x, size) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _counts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << SEGMENT) - 1))) for s in range(0, 64, SEGMENT)]


def own_cell(fp: Column) -> Column:
    """The grid cell of a fingerprint: its bit counts as one number, four bits for a segment's count."""
    own = F.lit(0).cast("long")
    for k, n in enumerate(_counts(fp)):
        own = own.bitwiseOR(F.shiftleft(n.cast("long"), SEGMENT * k))
    return own


def cells(fp: Column) -> Column:
    """The grid cells within Manhattan distance 1 of a fingerprint's bit counts.

    Fingerprints with two differing bits have counts at Manhattan distance 2 at most, and so a common cell.
    """
    own = own_cell(fp)
    steps = F.flatten(F.array(*(F.array(F.when(n > 0, F.lit(-(1 << SEGMENT * k))), F.when(n < SEGMENT, F.lit(1 << SEGMENT * k))) for k, n in enumerate(_counts(fp)))))
    moved = F.transform(F.filter(steps, lambda d: d.isNotNull()), lambda d: own + d)
    return F.concat(F.array(own), moved)


def _spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew before each row becomes many, so that a small table doesn't leave the work to a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def links(nodes: DataFrame) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints ``nodes(fp)`` that connect all within DISTANCE bits, and no others.

    Candidates are fingerprints of a common cell. Up to PAIRED of a cell are compared with each other bit by bit. The
    fingerprints of fuller cells are verified without pairing: two of them differ in at most two bits if and only if they share
    a midpoint, which is one of them or either with one bit flipped; all of a midpoint are linked with the smallest one.
    """
    placed = _spread(nodes).select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    full = written(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "cells")
    two = full.where("n = 2").select("a", "b")
    members = written(placed.join(full.where("n > 2").select("cell", "n"), "cell"), "members")
    lists = members.where(F.col("n") <= PAIRED).groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    pairs = lists.select("fps", F.explode("fps").alias("a")).select("a", F.explode(F.filter("fps", lambda b: b > F.col("a"))).alias("b"))
    flips = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    middle = _spread(members.where(F.col("n") > PAIRED).select("fp").distinct()).select("fp", F.explode(flips).alias("middle"))
    least = middle.groupBy("middle").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = middle.join(least, "middle").where("fp != a").select("a", F.col("fp").alias("b"))
    return two.union(pairs).union(stars).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id that can be reached over links, the row's own included. Rows of equal fingerprint are
    one node, so copies are never paired. Texts without words, null among them, have fingerprint 0 and are linked
    like any other. Null doc_ids are kept and never smallest; a component of such rows alone has component_id null. Repeated
    rows each give a row.
    """
    hashed = written(fingerprints(docs, size), "fingerprints")
    nodes = hashed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes.select("fp")))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return hashed.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# Near copies by the similarity of their shingles


def text_hash(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def part_fingerprints(texts: list[bytes | None], size: int = NEAR_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``owner, place, fp``: SimHash fingerprints of parts of each text's set of shingles.

    Shingles are dealt by a hash into so many parts that a part has two to four of them, 24 at least. Where there are more than
    PARTS parts, the first PARTS are used; a part without shingles has no fingerprint. An unchanged part has an equal fingerprint. The number of
    parts depends on the text's number of shingles by powers of two; a text that could have a near copy of the next power has fingerprints for
    that one as well. ``place`` names power and part.

    Of two texts at similarity 0.8, a part is unchanged and not empty with probability 0.37 at least, so they have no
    fingerprint in common with probability 0.63 ** 24 = 0.000015 at most, and fewer than two with 0.0002.
    """
    sets = [np.unique(shingle_hashes(t, size)) for t in texts]
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), counts)
    # a hash apart from the bits that make the fingerprint
    lot = hashes * np.uint64(0x9E3779B97F4A7C15)
    lot = (lot ^ (lot >> np.uint64(32))) >> np.uint64(1)
    power = np.log2(np.maximum(counts, 1)).astype(np.int64)
    reach = np.log2(np.maximum(counts, 1) / SIMILARITY).astype(np.int64)
    found = []
    for level, use in ((power, np.ones(len(sets), bool)), (reach, reach > power)):
        parts = np.maximum(PARTS, (1 << np.maximum(level - 1, 0)) + 1)
        part = (lot % parts[owner].astype(np.uint64)).astype(np.int64)
        keep = np.flatnonzero((part < PARTS) & use[owner])
        key = owner[keep] * PARTS + part[keep]
        keep = keep[np.argsort(key, kind="stable")]
        key = owner[keep] * PARTS + part[keep]
        if not len(key):
            continue
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        bits = np.unpackbits(hashes[keep].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        n = np.diff(np.append(starts, len(key)))
        fp = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<i8")[:, 0]
        found.append((key[starts] // PARTS, level[key[starts] // PARTS] * PARTS + key[starts] % PARTS, fp))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.argsort(out[0], kind="stable")
    return tuple(c[order] for c in out)


def sketches(docs: DataFrame, size: int = NEAR_SHINGLE) -> DataFrame:
    """``doc_id, node, place, fp`` for each row of ``docs(doc_id, text)``: a hash of its text, and arrays of ``part_fingerprints``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            owner, place, fp = part_fingerprints(batch.column(2).to_pylist(), size)
            ends = pa.array(np.searchsorted(owner, np.arange(len(batch) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place.astype(np.int32), fp)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "node", "place", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("node"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, node long, place array<int>, fp array<long>")


def _placed(nodes: DataFrame) -> DataFrame:
    """``node, parts, fp, cell`` for each fingerprint of ``nodes``: a cell is one of the grid of its place, found by bit counts."""
    rows = nodes.select("node", F.size("place").alias("parts"), F.explode(F.arrays_zip("place", "fp")).alias("x")).select("node", "parts", "x.place", "x.fp")
    return rows.select("node", "parts", "fp", F.xxhash64("place", own_cell(F.col("fp"))).alias("cell"))


def sharing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` with two fingerprints in common, or one if either text has few."""
    keys = nodes.select("node", F.transform(F.arrays_zip("place", "fp"), lambda x: F.xxhash64(x["place"], x["fp"])).alias("keys"))
    side = lambda name: keys.select(F.col("node").alias(name), F.col("keys").alias(f"keys_{name}"))
    needed = F.when(F.least(F.size("keys_a"), F.size("keys_b")) >= MANY, 2).otherwise(1)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.size(F.array_intersect("keys_a", "keys_b")) >= needed).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _within(members: DataFrame, key: str) -> DataFrame:
    """All pairs of the members of a cell, for cells of PAIRED at most."""
    lists = members.groupBy(key).agg(F.collect_list("node").alias("nodes"))
    return lists.select("nodes", F.explode("nodes").alias("a")).select("a", F.explode("nodes").alias("b"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(text_hash(F.col("text")).alias("node"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def verified(pairs: DataFrame, docs: DataFrame, size: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs(a, b)`` of nodes whose texts share at least ``similarity`` of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            keep, last, a = [], None, None
            for i in range(batch.num_rows):
                if (text := batch.column(2)[i].as_py()) != last:
                    last, a = text, np.unique(shingle_hashes(text, size))
                b = np.unique(shingle_hashes(batch.column(3)[i].as_py(), size))
                alike = min(len(a), len(b)) >= similarity * max(len(a), len(b))
                both = len(np.intersect1d(a, b, assume_unique=True)) if alike else 0
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
    # few texts are needed: the others go before the shuffle
    texts = thinned(_texts(docs), "node", bitmap(needed)).join(needed, "node", "left_semi")
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _centred(members: DataFrame) -> DataFrame:
    """Pairs of each member of a cell and the one that is in most cells with others, ties by hash: the likeliest origin of copies."""
    often = members.groupBy("node").agg(F.count("*").alias("often"))
    rows = members.join(often, "node")
    rank = F.shiftleft("often", 44) + F.xxhash64("node").bitwiseAND(F.lit((1 << 44) - 1))
    centre = written(rows.groupBy("cell").agg(F.max_by("node", rank).alias("a")), "centres")
    return members.join(centre, "cell").select("a", F.col("node").alias("b"))


def apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """``node, root`` of members of cells with more than PAIRED texts that share them with another component.

    Texts with many fingerprints count only where they share a second cell with another component as well.
    """
    rows = members.where(F.col("n") > PAIRED).join(found, "node", "left").select("cell", "node", "parts", F.coalesce("root", "node").alias("root"))
    rows = written(rows, "rooted")
    # of several components
    several = lambda df, key: df.join(df.groupBy(key).agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select(key), key, "left_semi")
    rows = written(several(rows, "cell"), "open")
    both = rows.where(F.col("parts") >= MANY).join(members.select("node", F.col("cell").alias("second")), "node").where("cell != second")
    both = written(both.select(F.xxhash64(F.least("cell", "second"), F.greatest("cell", "second")).alias("both"), "node", "root").distinct(), "both")
    return written(several(both, "both").select("node", "root").union(rows.where(F.col("parts") < MANY).select("node", "root")).distinct(), "apart")


def prefix_pairs(rows: DataFrame, docs: DataFrame, size: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of ``rows(node, root)`` of different roots, among them all with the similarity: a prefix filter on the texts' shingles.

    Shingles are ordered by the number of texts among ``rows`` that have them, the rarest first. Two sets of sizes n1 >= n2 with the similarity s have
    at least ``s / (1 + s) * (n1 + n2)`` shingles in common, so the first one that they have in common comes early in both: it has a place of
    at most ``n1 - s * n1`` in the larger and ``n2 - 2 * s / (1 + s) * n2`` in the smaller set. Only these beginnings are joined, and only pairs come out
    that can still reach the number. A copy with enough changes of its own begins with shingles that no other text has, and meets nobody.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sets = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in batch.column(2).to_pylist()]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], ["node", "root", "shingles"])

    texts = thinned(_texts(docs), "node", bitmap(rows.select("node"))).join(rows, "node").groupBy("node", "root").agg(F.first("text").alias("text"))
    sets = written(texts.select("node", "root", "text").mapInArrow(run, "node long, root long, shingles array<long>"), "shingles")
    flat = sets.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = written(flat.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1"), "shared")
    own = Window.partitionBy("node")
    # shingles of one text come first, and are not needed but for their number
    first = F.col("n") - F.count("*").over(own)
    place = (first + F.row_number().over(own.orderBy("texts", "shingle")) - 1).alias("place")
    placed = flat.join(shared, "shingle").select("node", "root", "n", "shingle", place)
    least = lambda x: F.ceil(x - 1e-9)
    placed = written(placed.where(F.col("place") <= F.col("n") - least(similarity * F.col("n"))), "prefixes")
    smaller = placed.where(F.col("place") <= F.col("n") - least(2 * similarity / (1 + similarity) * F.col("n"))).select("shingle", *(F.col(c).alias(f"{c}2") for c in ("node", "root", "n", "place")))
    needed = similarity / (1 + similarity) * (F.col("n") + F.col("n2")) - 1e-9
    left = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    first = (F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("node2") < F.col("node")))  # each pair one way round
    fits = (F.col("root") != F.col("root2")) & first & (F.col("n2") >= similarity * F.col("n") - 1e-9) & (left >= needed)
    return _ordered(placed.join(smaller, "shingle").where(fits).select(F.col("node").alias("a"), F.col("node2").alias("b")))


def near_texts(docs: DataFrame, size: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, node, root`` for each row of ``docs(doc_id, text)``: rows of equal ``root`` are linked, directly or over others.

    Texts are linked if they share at least ``similarity`` of their ``size``-word shingles. One 64-bit fingerprint of a whole text can't tell: at
    0.8 it differs in about ten bits, too many for a grid. So parts of a text's shingles have fingerprints of their own (see
    ``part_fingerprints``), an unchanged part has the same bit counts, and texts that meet in a cell of the grid and have two fingerprints in
    common (one, if either has few) are verified on their whole texts. ``node`` is ``text_hash`` of the row's text: equal texts are one node, so copies are never paired.

    Up to PAIRED texts of a cell are compared with each other. In fuller cells each text meets one, and those of cells that are not all linked by
    then are compared by a prefix filter, which finds all that are similar without pairing the others (see ``prefix_pairs``).
    Texts without words, null among them, have one empty shingle and are linked. Repeated rows each give a row; doc_id may be null.
    """
    hashed = written(sketches(docs, size), "sketches")
    nodes = written(hashed.dropDuplicates(["node"]).select("node", "place", "fp"), "nodes")
    placed = _placed(nodes)
    full = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor("fp").alias("bits")).where("n > 1")
    full = written(full, "cells")
    two = full.where((F.col("n") == 2) & (F.bit_count("bits") <= DISTANCE)).select("a", "b")
    members = written(placed.join(full.select("cell", "n"), "cell").select("cell", "n", "node", "parts"), "members")
    few, many = members.where((F.col("n") > 2) & (F.col("n") <= PAIRED)), members.where(F.col("n") > PAIRED).select("cell", "node")
    pairs = written(sharing(_ordered(two.union(_within(few, "cell")).union(_centred(many))), nodes), "pairs")
    links = written(verified(pairs, docs, size, similarity), "links")
    found = components(links)
    more = prefix_pairs(apart(members, found), docs, size, similarity).join(pairs, ["a", "b"], "left_anti")
    more = written(more, "pairs")
    more = written(verified(more, docs, size, similarity), "links")
    if not more.isEmpty():
        found = components(links.union(more))
    discard(nodes, full, members, pairs)
    return hashed.join(found, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
