"""Near-duplicates by a chosen-path set similarity join on minwise tokens (Christiani and Pagh, 2017; Christiani et al., 2018)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixfield.llm.batches import slices
from mixfield.llm.common import written
from mixfield.llm.simhash import prefix_pairs, shingle_hashes, text_hash
from mixfield.llm.substrings import bitmap, thinned
from mixfield.operators.graph import components
from mixfield.operators.storage import discard

#: Sets are of so many words in a row, and linked if they share so many hundredths of their union.
SHINGLE, PERCENT = 4, 80
#: Each set has so many minwise tokens; the first TREES of them are the roots' choices.
TOKENS, TREES = 64, 8
#: A node of the trees with at most so many sets is compared exhaustively; a larger one branches by so many further tokens.
SMALL, BRANCH = 16, 2
#: In larger nodes a set is compared with so many centres at most.
CENTRES = 2
#: Trees branch so often below their roots at most; what is not apart by then is joined by a prefix filter, which is exact.
DEPTH = 2
#: Pairs with fewer equal tokens are not verified: two sets at 0.8 have 51 of 64 in expectation, and fewer than 32 with a probability below 1e-8.
ALIKE = 32
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(TOKENS)], np.uint64)


def minwise_tokens(hashes: np.ndarray) -> np.ndarray:
    """TOKENS numbers of a set of hashes: two sets agree in each with the probability of their similarity."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 4096):
        mixed = hashes[a : a + 4096, None] * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, mixed.min(axis=0))
    return ((least ^ (least >> np.uint64(31))) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Distinct hashes of a text's shingles in order; none without words."""
    return np.unique(shingle_hashes(text, size)) if text and text.strip() else np.zeros(0, np.uint64)


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, t1, t2, n, k1, k2, tokens`` for each row of ``docs(doc_id, text)``: 128 bits of hash of the text, size and 128 bits of digest of its set, and the set's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            sets = [shingle_set(t, size) for t in batch.column(3).to_pylist()]
            digests = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
            tokens = pa.array(np.concatenate([minwise_tokens(s) for s in sets]) if sets else np.zeros(0, np.int32))
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TOKENS)
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], n, pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.ListArray.from_arrays(offsets, tokens)], ["doc_id", "t1", "t2", "n", "k1", "k2", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), *_text_keys(), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, t1 long, t2 long, n long, k1 long, k2 long, tokens array<int>")


def _text_keys() -> list[Column]:
    return [text_hash(F.col("text")).alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _compared(members: DataFrame, small: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` of ``members(cell, node, n, root, size)`` of different roots: all of a small cell, and of a larger one each with its centre.

    The centre is the set that is in most large cells, ties by hash: the likeliest origin of copies. A set of many cells is compared with the likeliest CENTRES of theirs.
    """
    few, many = members.where(F.col("size") <= small), members.where(F.col("size") > small)
    lists = few.groupBy("cell").agg(F.collect_list(F.struct("node", "n", "root")).alias("others"))
    pairs = lists.select("others", F.explode("others").alias("x")).select("x", F.explode(F.filter("others", lambda y: y["node"] > F.col("x.node"))).alias("y"))
    pairs = pairs.where((F.col("x.root") != F.col("y.root")) & _fits("x.n", "y.n", percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    often = many.groupBy("node").agg(F.count("*").alias("often"))
    rank = F.struct("often", F.xxhash64("node"))
    centre = many.join(often, "node").groupBy("cell").agg(F.max_by(F.struct("node", "n", "root"), rank).alias("x"), (-F.max("often")).alias("order"))
    stars = many.join(written(centre, "centres"), "cell").where((F.col("root") != F.col("x.root")) & _fits("n", "x.n", percent))
    # a set of centres has TREES * BRANCH ** DEPTH members at most
    stars = stars.groupBy("node").agg(F.collect_set(F.struct("order", F.xxhash64("x.node").alias("hash"), F.col("x.node").alias("x"))).alias("centres"))
    stars = stars.select("node", F.explode(F.slice(F.sort_array("centres"), 1, CENTRES)["x"]).alias("x"))
    stars = stars.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b"))
    return pairs.union(stars).distinct()


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs with ALIKE equal tokens at least."""
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("tokens").alias(f"tokens_{name}"))
    equal = F.aggregate(F.zip_with("tokens_a", "tokens_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(equal >= ALIKE).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets are similar enough. Only the texts of nodes in a pair are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            keep, last, x = [], None, None
            for i in range(batch.num_rows):
                if (text := batch.column(2)[i].as_py()) != last:
                    last, x = text, shingle_set(text, size)
                y = shingle_set(batch.column(3)[i].as_py(), size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "t1", "t2"), "node")
    needed = written(needed, "needed")
    texts = docs.select(*_text_keys(), F.col("text").cast("binary").alias("text"))
    # copies of a text are many, and one of them is enough
    texts = thinned(texts, "t1", bitmap(needed.select("t1"))).join(needed, ["t1", "t2"]).groupBy("node").agg(F.first("text").alias("text"))
    texts = written(texts, "texts")
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    links = written(sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")
    discard(needed, texts)
    return links


def _full(rows: DataFrame, name: str) -> DataFrame:
    """``rows(cell, node, n, root)`` of cells with more than one root, with ``size``, the number of the cell's sets."""
    cells = written(rows.groupBy("cell").agg(F.count("*").alias("size"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("cell", "size"), f"{name}-cells")
    out = written(rows.join(cells, "cell"), name)
    discard(cells)
    return out


def _branched(rows: DataFrame, nodes: DataFrame, level: int, branch: int, depth: int) -> DataFrame:
    """``cell, node, n, root`` one level down: a cell chooses ``branch`` tokens of this level's share by its own number, and its sets part by them."""
    share = (TOKENS - TREES) // depth
    first = TREES + share * (level - 1)
    rows = rows.select("cell", "node", "n", "root").join(nodes.select("node", F.slice("tokens", first + 1, share).alias("tokens")), "node")
    at = F.pmod(F.xxhash64("cell"), F.lit(share))
    # two different tokens: the second is some steps after the first
    chosen = F.array(*((at + (F.lit(0) if i == 0 else 1 + F.pmod(F.xxhash64(F.lit(i), "cell"), F.lit(share - 1)))) % share for i in range(branch)))
    rows = rows.withColumn("at", F.explode(F.array_distinct(chosen)))
    return rows.select(F.xxhash64("cell", "at", F.get("tokens", F.col("at").cast("int"))).alias("cell"), "node", "n", "root")


def links(nodes: DataFrame, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, small: int = SMALL, branch: int = BRANCH, depth: int = DEPTH) -> DataFrame:
    """Edges ``a, b`` between similar sets of ``nodes(node, n, t1, t2, tokens)`` that connect all similar ones.

    Each of TREES trees parts the sets by a minwise token at its root. In a node of a tree with ``small`` sets or fewer all pairs are compared. A larger node compares
    all with one centre, and if not all are linked by then, it branches: by ``branch`` tokens, which the node chooses. Sets that are linked already,
    directly or over others, are not compared again, and a node of linked sets is done with. What is still in large nodes after ``depth`` branchings is compared by a prefix filter.

    Two sets at 0.8 part at a root with probability 0.2 and at none of the further nodes that both are in with 0.06 at most, however deep, so they meet in no tree with 0.25 ** 8 = 2e-5, and in
    3e-6 of cases where nodes are small; at 0.9 these are 2e-8 and 1e-8. Candidates are verified on whole sets.
    """
    roots = nodes.select("node", "n", F.posexplode(F.slice("tokens", 1, TREES)).alias("tree", "token"))
    rows = roots.select(F.xxhash64("tree", "token").alias("cell"), "node", "n", F.col("node").alias("root"))
    known = found = None
    seen = None
    for level in range(1, depth + 2):
        members = _full(rows, f"members-{level}")
        pairs = _compared(members, small, percent)
        pairs = written(_alike(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), nodes), f"pairs-{level}")
        seen = pairs if seen is None else seen.union(pairs)
        new = _verified(pairs, nodes, docs, size, percent)
        known = new if known is None else known.union(new)
        large = members.where(F.col("size") > small).select("cell", "node", "n")
        if large.isEmpty():
            return known
        found = written(components(known), "roots")
        rooted = large.join(found, "node", "left").select("cell", "node", "n", F.coalesce("root", "node").alias("root"))
        several = rooted.groupBy("cell").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("cell")
        rows = written(rooted.join(several, "cell", "left_semi"), f"open-{level}")
        discard(members, found)
        if rows.isEmpty():
            return known
        if level <= depth:
            rows = _branched(rows, nodes, level, branch, depth)
    rest = rows.select("node", "root").distinct().join(nodes.select("node", "t1"), "node")
    more = prefix_pairs(rest.select(F.col("t1").alias("node"), "root"), docs, size, percent / 100)
    named = lambda name: rest.select(F.col("t1").alias(name), F.col("node").alias(f"node_{name}"))
    more = more.join(named("a"), "a").join(named("b"), "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return known.union(_verified(written(more.join(seen, ["a", "b"], "left_anti"), "pairs-rest"), nodes, docs, size, percent))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, small: int = SMALL, branch: int = BRANCH, depth: int = DEPTH) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    A document's set has the distinct runs of ``size`` words of its whole text, A-Z in lower case, or its whole sequence of words if there are fewer. Documents are linked
    whose sets share ``percent`` hundredths of their union; ``component_id`` is the smallest doc_id that can be reached, the row's own included. Equal sets are one node,
    so copies are never paired. Texts without words, null among them, have ``n_shingles`` 0 and are linked with nothing, not even with each other. A null doc_id is never smallest: rows without one
    have the component_id of their component, null if it has none, and ``kept`` is doc_id = component_id, true if both are null. Repeated rows each give a row. Other columns are dropped.
    """
    hashed = written(sketches(docs, size), "sketches")
    some = hashed.where("n > 0")
    text = F.min(F.struct("t1", "t2")).alias("text")
    nodes = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), text, F.first("tokens").alias("tokens"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "first", "n", "text.t1", "text.t2", "tokens"), "nodes")
    found = components(links(nodes, docs, size, percent, small, branch, depth))
    rooted = nodes.join(found, "node", "left").select("k1", "k2", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("k1", "k2", "component_id")
    out = some.join(classes, ["k1", "k2"]).select("doc_id", "n", "component_id").union(hashed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
