"""Nearest neighbours by additive quantisation, with exact reranking and a check that no vector left out may be nearer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixfield.llm.common import smallest, written

#: At most so many vectors, those with the smallest hash, train the codebooks and cells.
FIT_VECTORS = 16_384
BOOKS, WORDS, BEAM = 16, 256, 4
#: A cell has about so many vectors, and there are so many cells at most.
CELL_ROWS, CELLS = 4096, 4096
#: A query visits the nearest cells until they have the share of all vectors that holds TARGET of the nearest neighbours of PROBED vectors of the sample. Where
#: vectors point in all directions alike, a neighbour may be in any cell, and that takes most of the vectors; for vectors in clear groups little is enough.
TARGET, PROBED = 0.97, 512
#: A task scores about so many vectors of a cell for about so many queries at a time.
BLOCK, QUERIES = 8192, 1024
#: So many vectors by quantised distance are taken from each block of a cell, and so many of all are reranked.
LOCAL, SHORTLIST = 128, 512
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Codebooks:
    """``books[m, k]`` is a whole vector; a vector is approximated by the sum of one word of each book. ``cells`` are centres.

    All work on what ``centred`` gives: vectors less ``mean``, taken away in double precision, so that an offset common to all vectors doesn't drown their differences.
    A query visits the nearest cells with ``share`` of all vectors.
    """

    books: np.ndarray
    cells: np.ndarray
    mean: np.ndarray | float = 0.0
    share: float = 1.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean).astype(np.float32)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared lengths of the approximations: of ``beam`` choices so far, the best ``beam`` with one more word are kept."""
        n, dim = x.shape
        left = x[:, None, :].astype(np.float32)  # what each choice leaves over
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            words = (book**2).sum(axis=1)
            cost = (left**2).sum(axis=2)[:, :, None] - 2 * left @ book.T + words
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            at, word = best // len(book), best % len(book)
            left = np.take_along_axis(left, at[:, :, None], axis=1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, at[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        first = (left**2).sum(axis=2).argmin(axis=1)
        codes = codes[np.arange(n), first]
        return codes, (self.decode(codes) ** 2).sum(axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, lengths: np.ndarray | float = 1.0) -> np.ndarray:
        """Squared distances but for the queries' own length, from tables of inner products of queries and words; ``norms`` are those of codes times ``lengths``."""
        tables = np.einsum("mkd,qd->mkq", self.books, queries.astype(np.float32))
        out = np.zeros((len(codes), len(queries)), np.float32)
        for m, table in enumerate(tables):
            out += table[codes[:, m]]
        return (norms - 2 * np.asarray(lengths, np.float32) * out.T).astype(np.float32)

    def near_cells(self, x: np.ndarray) -> np.ndarray:
        """Squared distances from the cells' centres, but for the length of ``x``."""
        return (self.cells**2).sum(axis=1) - 2 * x.astype(np.float32) @ self.cells.T


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres, or as many as there are rows."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        order = np.argsort(near, kind="stable")
        found, starts = np.unique(near[order], return_index=True)
        centres[found] = np.add.reduceat(x[order], starts, axis=0) / np.diff(np.append(starts, len(x)))[:, None]
    return centres


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 7, cells: int = 1) -> Codebooks:
    """Codebooks for the rows of ``x``: k-means on what the books before leave over; and the centres of cells."""
    rng = np.random.default_rng(seed)
    left, out = x.astype(np.float32).copy(), []
    for _ in range(books):
        book = kmeans(left, words, rounds, rng)
        near = ((book**2).sum(axis=1) - 2 * left @ book.T).argmin(axis=1)
        left -= book[near]
        out.append(np.concatenate([book, np.zeros((words - len(book), x.shape[1]), np.float32)]))
    return Codebooks(np.array(out), kmeans(x.astype(np.float32), cells, rounds, rng))


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and their lengths: codes are of directions, so that short vectors among long ones are told apart as well. A zero vector stays."""
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)
    return x / np.where(length > 0, length, 1)[:, None], length


def share_needed(x: np.ndarray, cells: np.ndarray, k: int = 10, target: float = TARGET, probed: int = PROBED) -> float:
    """The share of the rows of ``x`` in the nearest cells of a query that holds ``target`` of the ``k`` nearest rows, over the first ``probed`` rows as queries."""
    k = min(k, len(x) - 1)
    if k < 1 or len(cells) == 1:
        return 1.0
    norms = (x**2).sum(axis=1)
    own = ((cells**2).sum(axis=1) - 2 * x @ cells.T).argmin(axis=1)
    sizes = np.bincount(own, minlength=len(cells))
    needed = []
    for a in range(0, min(probed, len(x)), 128):
        q = x[a : min(a + 128, probed)]
        away = norms - 2 * q @ x.T
        away[np.arange(len(q)), a + np.arange(len(q))] = np.inf
        near = own[np.argpartition(away, k - 1, axis=1)[:, :k]]
        order = np.argsort((cells**2).sum(axis=1) - 2 * q @ cells.T, axis=1, kind="stable")
        upto = np.cumsum(sizes[order], axis=1)
        by_cell = np.empty_like(upto)
        np.put_along_axis(by_cell, order, upto, axis=1)
        needed.append(np.take_along_axis(by_cell, near, axis=1).ravel())
    return float(np.quantile(np.concatenate(needed), target)) / len(x)


def usable(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, dim, embedding, h1, h2`` of the vectors that take part: not null, not all zero, and without null or non-finite components.

    ``row`` numbers the rows, ``h1, h2`` are 128 bits of hash that equal vectors share. A vec_id may be null or repeated.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda v: v != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("embedding").alias("dim"), "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))


def build(nodes: DataFrame, books: int = BOOKS, words: int = WORDS, sample: int = FIT_VECTORS) -> tuple[Codebooks, DataFrame]:
    """Codebooks, and the index ``h1, h2, cell, codes, norm, length, error, away`` of all ``nodes(h1, h2, embedding)``, of which there is one at least; ``away`` is the distance from the cell's centre."""
    n = nodes.count()
    # at most ``sample`` vectors reach the driver
    fitted = np.stack(smallest(nodes.select("h1", "h2", "embedding"), sample, "h1", "h2").toPandas()["embedding"].to_numpy())
    cells = max(1, min(CELLS, len(fitted) // 4, round(n / CELL_ROWS)))
    mean = fitted.mean(axis=0)
    x = (fitted - mean).astype(np.float32)
    centres = kmeans(x, cells, 8, np.random.default_rng(11))
    coder = replace(train(directions(x)[0], books, words), cells=centres, mean=mean, share=share_needed(x, centres))
    shared = nodes.sparkSession.sparkContext.broadcast(coder)  # books * words and CELLS vectors at most

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), 1024):
                rows = part.iloc[a : a + 1024]
                x = shared.value.centred(np.stack(rows["embedding"].to_numpy()))
                unit, length = directions(x)
                codes, norms = shared.value.encode(unit)
                error = np.sqrt(((x.astype(np.float64) - length[:, None] * shared.value.decode(codes)) ** 2).sum(axis=1))
                cell = shared.value.near_cells(x).argmin(axis=1)
                away = np.sqrt(((x.astype(np.float64) - shared.value.cells[cell]) ** 2).sum(axis=1))
                yield pd.DataFrame({"h1": rows["h1"], "h2": rows["h2"], "cell": cell, "codes": [c.tobytes() for c in codes], "norm": (norms * length**2).astype(np.float32), "length": length, "error": error, "away": away})

    return coder, written(nodes.select("h1", "h2", "embedding").mapInPandas(run, "h1 long, h2 long, cell int, codes binary, norm float, length float, error double, away double"), "codes")


def probes(asked: DataFrame, coder: Codebooks, sizes: np.ndarray, widths: np.ndarray | None = None) -> DataFrame:
    """``q1, q2, vector, cell, reach`` for each cell that a query of ``asked(h1, h2, embedding, reach)`` visits: the nearest ones, with the query as ``coder`` takes it.

    With ``widths``, the distances of the cells' farthest vectors from their centres: all cells that may have a vector within ``reach``, with the query's own vector in double precision.
    """
    shared = asked.sparkSession.sparkContext.broadcast((coder, sizes, widths))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, n, widths = shared.value
        for part in parts:
            for a in range(0, len(part), 256):
                rows = part.iloc[a : a + 256]
                vectors = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
                x, reach = own.centred(vectors), rows["reach"].to_numpy(np.float64, na_value=np.nan)
                if widths is None:
                    order = np.argsort(own.near_cells(x), axis=1, kind="stable")
                    seen = np.cumsum(n[order], axis=1) - n[order]
                    at, place = np.nonzero((seen < own.share * n.sum()) & (n[order] > 0))
                    cell, vectors = order[at, place], x
                else:
                    y, cells = x.astype(np.float64), own.cells.astype(np.float64)
                    lengths, there = (y**2).sum(axis=1)[:, None], (cells**2).sum(axis=1)
                    # rounding of single precision is allowed for; what is not a number is visited
                    least = np.sqrt(np.maximum(lengths + there - 2 * y @ cells.T, 0)) - widths - 1e-5 * (np.sqrt(lengths) + np.sqrt(there) + widths)
                    at, cell = np.nonzero(~(least > reach[:, None]) & (n > 0))
                vectors = np.array([v.tobytes() for v in vectors], object)
                yield pd.DataFrame({"q1": rows["h1"].to_numpy()[at], "q2": rows["h2"].to_numpy()[at], "vector": vectors[at], "cell": cell, "reach": reach[at]})

    return asked.select("h1", "h2", "embedding", "reach").mapInPandas(run, "q1 long, q2 long, vector binary, cell int, reach double")


def _met(visits: DataFrame, index: DataFrame, sizes: np.ndarray, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The queries of ``visits`` and the rows of ``index`` with ``columns``, both with ``cell, block, group``: a cell's vectors and queries meet in blocks of bounded size, so a full cell is shared out among tasks."""
    spark = visits.sparkSession
    asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
    plan = spark.createDataFrame([(c, -(-int(sizes[c]) // BLOCK), -(-n // QUERIES)) for c, n in asked.items()], "cell int, blocks int, groups int")
    plan = F.broadcast(plan)
    place = lambda n, *key: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(plan, "cell").select("cell", all_of("blocks").alias("block"), place("groups", "q1", "q2").alias("group"), "q1", "q2", "vector", "reach")
    right = index.join(plan, "cell").select("cell", place("blocks", "h1", "h2").alias("block"), all_of("groups").alias("group"), "h1", "h2", "codes", "norm", "length", *columns)
    return left, right


def shortlists(visits: DataFrame, index: DataFrame, coder: Codebooks, sizes: np.ndarray, shortlist: int) -> DataFrame:
    """``q1, q2, h1, h2``: for each query the ``shortlist`` vectors that are nearest by the lookup tables, of LOCAL from each block of its cells."""
    left, right = _met(visits, index, sizes)
    shared = visits.sparkSession.sparkContext.broadcast(coder)

    def run(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(there):
            codes = np.frombuffer(b"".join(there["codes"]), np.uint8).reshape(len(there), -1)
            norms, lengths, h1, h2 = there["norm"].to_numpy(), there["length"].to_numpy(), there["h1"].to_numpy(), there["h2"].to_numpy()
            q = np.frombuffer(b"".join(asked["vector"]), np.float32).reshape(len(asked), -1)
            keep = min(LOCAL, len(there))
            for a in range(0, len(asked), 64):
                scores = shared.value.scores(q[a : a + 64], codes, norms, lengths)
                own = asked.iloc[a : a + 64]
                best = np.argpartition(scores, keep - 1, axis=1)[:, :keep]
                out.append(pd.DataFrame({"q1": np.repeat(own["q1"].to_numpy(), keep), "q2": np.repeat(own["q2"].to_numpy(), keep), "h1": h1[best].ravel(), "h2": h2[best].ravel(), "near": np.take_along_axis(scores, best, axis=1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"q1": [], "q2": [], "h1": [], "h2": [], "near": []}).astype({"q1": "int64", "q2": "int64", "h1": "int64", "h2": "int64"})

    keys = ["cell", "block", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "q1 long, q2 long, h1 long, h2 long, near double")
    return _first(found, ["q1", "q2"], [F.col("near"), F.col("h1"), F.col("h2")], shortlist).drop("near")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of ``x`` and ``y``, in double precision, with squares added one by one as in ``_reranked``, so that ties are the same there."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += (x[:, j] - y[:, j]) ** 2
    return np.sqrt(total)


def still_near(visits: DataFrame, index: DataFrame, coder: Codebooks, sizes: np.ndarray, k: int) -> DataFrame:
    """``q1, q2, h1, h2``: all vectors that may be among a query's ``k`` nearest, ``k + 1`` of each block of the cells that it visits at most.

    ``index`` has ``embedding``, ``vec_id`` and ``row`` of a node's first row, ``visits`` the queries' own vectors. A vector is skipped if its distance by the tables, less the error of its code,
    is above the query's ``reach``. Of the others the nearest by exact distance stay, ties by ``vec_id`` (null last) and ``row``: since each node has a row, what is behind ``k + 1`` nodes is behind
    as many rows.
    """
    left, right = _met(visits, index, sizes, "error", "embedding", "vec_id", "row")
    shared = visits.sparkSession.sparkContext.broadcast(coder)
    columns = ["q1", "q2", "h1", "h2"]

    def run(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 4), np.int64)]
        if len(asked) and len(there):
            codes = np.frombuffer(b"".join(there["codes"]), np.uint8).reshape(len(there), -1)
            norms, lengths, errors, hashes = there["norm"].to_numpy(), there["length"].to_numpy(), there["error"].to_numpy(), there[["h1", "h2"]].to_numpy()
            # places in the order of ties
            order = np.empty(len(there), np.int64)
            order[there.assign(_none=there["vec_id"].isna()).reset_index(drop=True).sort_values(["_none", "vec_id", "row"]).index.to_numpy()] = np.arange(len(there))
            vectors = np.stack(there["embedding"].to_numpy()).astype(np.float64)
            own = np.frombuffer(b"".join(asked["vector"]), np.float64).reshape(len(asked), -1)
            # what all vectors have in common is taken away, so that products lose less
            mean = np.asarray(shared.value.mean, np.float64)
            centred = vectors - mean
            squares = (centred**2).sum(axis=1)
            for a in range(0, len(asked), 64):
                rows = asked.iloc[a : a + 64]
                reach = rows["reach"].to_numpy(np.float64)
                exact = own[a : a + 64]
                part = shared.value.centred(exact)
                length = (part.astype(np.float64) ** 2).sum(axis=1)[:, None]
                scores = shared.value.scores(part, codes, norms, lengths)
                # rounding of single precision is allowed for; what is not a number stays
                least = np.sqrt(np.maximum(scores + length, 0)) - errors - 1e-3 * np.sqrt(norms + length)
                may = ~(least > reach[:, None])
                if not may.any():
                    continue
                near = np.flatnonzero(may.any(axis=0))
                y = exact - mean
                length = (y**2).sum(axis=1)[:, None]
                d2 = length + squares[near] - 2 * y @ centred[near].T
                slack = 1e-12 * (length + squares[near])
                d2[~may[:, near]] = np.inf
                keep = min(k, len(near) - 1)
                bound = np.minimum(np.partition(d2 + slack, keep, axis=1)[:, keep] if len(near) > k else np.inf, reach**2 * (1 + 1e-9))
                at, place = np.nonzero(may[:, near] & ~(d2 - slack > bound[:, None]))
                place = near[place]
                score = np.concatenate([distances(exact[at[i : i + BLOCK]], vectors[place[i : i + BLOCK]]) for i in range(0, len(at), BLOCK)] or [np.zeros(0)])
                inside = ~(score > reach[at])
                at, place, score = at[inside], place[inside], score[inside]
                first = np.lexsort((order[place], score, at))
                at, place = at[first], place[first]
                starts = np.searchsorted(at, np.arange(len(rows)))
                best = np.arange(len(at)) - starts[at] <= k
                out.append(np.concatenate([rows[["q1", "q2"]].to_numpy()[at[best]], hashes[place[best]]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=columns)

    keys = ["cell", "block", "group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "q1 long, q2 long, h1 long, h2 long")


def _first(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def search(vectors: DataFrame, every: int = 100, k: int = 10, shortlist: int = SHORTLIST, exact: bool = True) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each usable vector whose vec_id is divisible by ``every``.

    Every other usable row of the same dimension is a candidate (see ``usable``), also one with the query's vec_id, or without any; each dimension has an
    index of its own. Equal vectors are one node, so copies of a vector are searched and found once. Each node belongs to the cell of the nearest
    centre; a query visits the nearest cells, with their codes only, until they have the share of all nodes that ``share_needed`` finds in the sample. All
    nodes of these are scored by lookup tables, the best ``shortlist`` are fetched and reranked by the exact Euclidean distance of the original vectors in double
    precision; ties go to the smaller vec_id, null last. What was found then bounds the distance of the ``k``-th: every cell that may have a nearer vector is visited, and every vector in it whose
    code and error allow a smaller distance is compared as well, so the result is that of a full search, whatever the vectors. Without ``exact`` that is left out: how many of the nearest are found then depends on
    how well codes tell them apart. With fewer than ``k`` candidates all are returned, and without candidates or queries there are no rows.
    """
    rows = written(usable(vectors), "vectors")
    out = vectors.sparkSession.createDataFrame([], RESULT)
    for r in rows.groupBy("dim").agg(F.count_if(F.col("vec_id") % every == 0).alias("queries")).orderBy("dim").collect():
        if r["queries"]:
            out = out.unionByName(_search(rows.where(F.col("dim") == r["dim"]), every, k, shortlist, exact).drop("row"))
    return out


def _search(rows: DataFrame, every: int, k: int, shortlist: int, exact: bool) -> DataFrame:
    first = F.min_by(F.struct("vec_id", "row"), F.struct(F.col("vec_id").isNull(), "vec_id", "row"))
    nodes = written(rows.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), first.alias("first")).select("h1", "h2", "embedding", "first.*"), "nodes")
    coder, index = build(nodes)
    sizes, widths = np.zeros(len(coder.cells), np.int64), np.zeros(len(coder.cells))
    for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("width")).collect():  # CELLS rows at most
        sizes[r["cell"]], widths[r["cell"]] = r["n"], r["width"]
    queries = rows.where(F.col("vec_id") % every == 0).select("row", F.col("vec_id").alias("query_id"), "h1", "h2")
    asked = nodes.select("h1", "h2", "embedding").join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    asked = asked.withColumn("reach", F.lit(None).cast("double"))
    visits = written(probes(asked, coder, sizes), "visits")
    found = written(shortlists(visits, index, coder, sizes, shortlist), "shortlists")
    result = _reranked(found, nodes, rows, queries, k)
    if not exact:
        return result
    # the distance of the k-th row bounds those that may still come; with fewer found there is no bound
    reach = result.groupBy("row").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("far"))
    reach = queries.join(reach, "row", "left").groupBy("h1", "h2").agg(F.max(F.coalesce("far", F.lit(float("inf")))).alias("reach"))
    visits = written(probes(asked.drop("reach").join(reach, ["h1", "h2"]), coder, sizes, widths), "visits")
    near = still_near(visits, index.join(nodes, ["h1", "h2"]), coder, sizes, k)
    return _reranked(written(near, "near"), nodes, rows, queries, k)


def _reranked(found: DataFrame, nodes: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score, row`` by exact distances of the pairs ``found(q1, q2, h1, h2)``; ``row`` is the query's."""
    vector = lambda a, b, name: nodes.select(F.col("h1").alias(a), F.col("h2").alias(b), F.col("embedding").alias(name))
    exact = found.join(vector("h1", "h2", "x"), ["h1", "h2"]).join(vector("q1", "q2", "y"), ["q1", "q2"])
    squares = F.zip_with("x", "y", lambda a, b: (a - b) * (a - b))
    exact = exact.select("q1", "q2", "h1", "h2", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)).alias("score"))
    order = [F.asc_nulls_last("vec_id"), F.col("row")]
    # of equal vectors the first k + 1 rows are enough, since one may be the query's own
    members = _first(rows.select("h1", "h2", "vec_id", "row"), ["h1", "h2"], order, k + 1)
    near = _first(exact.join(members, ["h1", "h2"]), ["q1", "q2"], [F.col("score"), *order], k + 1).select("q1", "q2", "vec_id", F.col("row").alias("other"), "score")
    pairs = queries.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), "row", "query_id").join(near, ["q1", "q2"]).where("row != other")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score"), F.asc_nulls_last("vec_id"), F.col("other")))
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score", "row").where(F.col("rank") <= k)
