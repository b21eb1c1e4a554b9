"""Counts of near points, and nearest points, by tiles: a tile's points and those around it meet in a task, which makes no row for a pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixfield.operators.storage import written

#: Points of a tile on average, and with those around it at most; a tile with more is cut into smaller ones.
TILE, MOST = 30_000, 400_000
#: Pairs of points that are looked at together.
PAIRS = 1 << 20
#: Roles of a row in a tile.
ASKS, COUNTS = 1, 2
#: Bounds are taken wider by so much, relative to the radius and to the largest coordinate, and pairs between them compared exactly.
SLACK, ULPS = 1e-9, 4e-15


class Strips:
    """Points ``o`` in strips of width ``size`` on all axes but the first, in order of the first axis in each strip."""

    def __init__(self, o: np.ndarray, size: float):
        cells = np.floor(o[:, 1:] / size)
        self.size, self.low = size, cells.min(axis=0) if len(o) else np.zeros(o.shape[1] - 1)
        self.span = ((cells.max(axis=0) if len(o) else self.low) - self.low + 1).astype(np.int64)
        keys = self._keys((cells - self.low).astype(np.int64))
        self.order = np.lexsort((o[:, 0], keys))
        self.o = o[self.order]
        self.columns = [np.ascontiguousarray(x) for x in self.o.T]
        self.keys, starts, number = np.unique(keys[self.order], return_index=True, return_inverse=True)
        # the box that the points of a strip fill on the other axes
        self.least, self.most = (f.reduceat(self.o[:, 1:], starts, axis=0) if len(o) else o[:, 1:] for f in (np.minimum, np.maximum))
        self.x = np.unique(o[:, 0])
        self.places = number * (len(self.x) + 1) + np.searchsorted(self.x, self.o[:, 0])

    def _keys(self, cells: np.ndarray) -> np.ndarray:
        key = np.zeros(len(cells), np.int64)
        for a in range(cells.shape[1]):
            key = key * self.span[a] + cells[:, a]
        return key

    def at(self, strip: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
        """Where points of a strip that are not below ``x`` begin, or those above it for ``right``."""
        return np.searchsorted(self.places, strip * (len(self.x) + 1) + np.searchsorted(self.x, x, side))

    def around(self, q: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``q`` and a strip at most ``reach`` strips away from each, for one shift after the other."""
        if not len(self.keys) or not len(q):
            return
        own = np.clip(np.floor(q[:, 1:] / self.size) - self.low, -reach - 2.0, self.span + reach + 1.0).astype(np.int64)
        for shift in product(range(-reach, reach + 1), repeat=q.shape[1] - 1):
            cells = own + np.array(shift, np.int64)
            rows = np.flatnonzero(((cells >= 0) & (cells < self.span)).all(axis=1))
            keys = self._keys(cells[rows])
            strip = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            there = self.keys[strip] == keys
            yield rows[there], strip[there]

    def gaps(self, y: np.ndarray, strip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of ``y``, on all axes but the first, from the nearest and the farthest place of a strip's box."""
        low, high = self.least[strip], self.most[strip]
        return (np.maximum(np.maximum(low - y, y - high), 0) ** 2).sum(axis=1), (np.maximum(y - low, high - y) ** 2).sum(axis=1)


def matrix(rows: pa.Table, axes) -> np.ndarray:
    return np.stack([rows.column(a).to_numpy() for a in axes], axis=1)


def _expanded(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Ranges ``first`` to ``last`` in parts of about PAIRS: the ranges of a part, the sizes of these and all their places."""
    sizes = last - first
    upto, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        n = sizes[a:b]
        yield slice(a, b), n, np.arange(n.sum()) + np.repeat(first[a:b] - (np.cumsum(n) - n), n)
        a = b


def _d2(q: np.ndarray, n: np.ndarray, o: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``q``, each repeated ``n`` times, from the places ``at``."""
    return reduce(lambda a, b: a + b, [(np.repeat(q[:, k], n) - x[at]) ** 2 for k, x in enumerate(o)])


def counted(q: np.ndarray, o: np.ndarray, radius: float, parts: int = 4, how_close: str = "<=") -> np.ndarray:
    """For each row of ``q`` the number of rows of ``o`` within ``radius``: of a strip, what surely lies in the circle is counted by places, and only its rim is compared."""
    out = np.zeros(len(q), np.int64)
    strips, limit = Strips(o, radius / parts), radius * radius
    # in order of strips, so that searches go on from where the last one was
    order = np.lexsort((q[:, 0], *np.floor(q[:, 1:] / strips.size).T))
    q = q[order]
    off = ULPS * max((float(np.abs(x).max()) for x in (q, o) if x.size), default=0.0)
    for rows, strip in strips.around(q, parts + 1):
        near, far = strips.gaps(q[rows, 1:], strip)
        some = near <= limit * (1 + SLACK)
        rows, strip, near, far = rows[some], strip[some], near[some], far[some]
        x = q[rows, 0]
        wide = np.sqrt(limit * (1 + SLACK) - near) * (1 + SLACK) + off
        sure = np.sqrt(np.maximum(limit * (1 - SLACK) - far, 0)) * (1 - SLACK) - off
        first, last = strips.at(strip, x - wide, "left"), strips.at(strip, x + wide, "right")
        begin, end = strips.at(strip, x - sure, "left"), strips.at(strip, x + sure, "right")
        whole = (sure > 0) & (begin < end)
        begin, end = np.where(whole, begin, last), np.where(whole, end, last)
        # a row occurs once for a shift
        out[rows] += end - begin
        for a, b in ((first, begin), (end, last)):
            for part, n, at in _expanded(a, b):
                d2 = _d2(q[rows[part]], n, strips.columns, at)
                close = d2 <= limit if how_close == "<=" else d2 < limit
                out[rows[part]] += np.bincount(np.repeat(np.arange(len(n)), n), close, len(n)).astype(np.int64)
    back = np.empty_like(out)
    back[order] = out
    return back


def nearest(q: np.ndarray, q_rank: np.ndarray | None, o: np.ndarray, o_key: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the squared distance to the nearest row of ``o`` within ``radius`` and its key, the smallest of equal distances; inf without one.

    With ``q_rank`` only rows with a smaller key count, else only those at a distance above 0. Places are searched in growing rings, each as a whole for what the ring before left open.
    """
    best, key, limit = np.full(len(q), np.inf), np.full(len(q), np.iinfo(np.int64).max), radius * radius
    if not len(o):
        return best, key
    # points at one place are one: the smallest key of them is what can be found there
    place, number = np.unique(o, axis=0, return_inverse=True)
    number = number.ravel()
    least = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(least, number, o_key)
    extent = float(np.prod(np.maximum(place.max(axis=0) - place.min(axis=0), radius * 1e-6)))
    ring = min(radius, max((4 * extent / len(place)) ** (1 / o.shape[1]), radius * 1e-6))
    left = np.arange(len(q))
    while len(left):
        strips, r2 = Strips(place, ring), ring * ring
        keys = least[strips.order]
        off = ULPS * float(max(np.abs(q[left]).max(), np.abs(place).max()))
        for rows, strip in strips.around(q[left], 1):
            rows = left[rows]
            x = q[rows, 0]
            # nothing farther than what is found can be nearer
            wide = np.sqrt(np.minimum(best[rows], r2)) * (1 + SLACK) + off
            near, _ = strips.gaps(q[rows, 1:], strip)
            some = near <= np.minimum(best[rows], r2) * (1 + SLACK)
            rows, strip, x, wide = rows[some], strip[some], x[some], wide[some]
            for part, n, at in _expanded(strips.at(strip, x - wide, "left"), strips.at(strip, x + wide, "right")):
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                own, starts = rows[part], (np.cumsum(n) - n)[some]
                d2 = _d2(q[own], n, strips.columns, at)
                wrong = keys[at] >= np.repeat(q_rank[own], n) if q_rank is not None else d2 <= 0
                d2[wrong | (d2 > limit)] = np.inf
                closest = np.minimum.reduceat(d2, starts)
                ids = np.minimum.reduceat(np.where(d2 == np.repeat(closest, n[some]), keys[at], np.iinfo(np.int64).max), starts)
                own = own[some]
                better = (closest < best[own]) | ((closest == best[own]) & (closest < np.inf) & (ids < key[own]))
                best[own[better]], key[own[better]] = closest[better], ids[better]
        # what a ring finds within its radius is final, even where rounding makes the radius a little less
        left = left[best[left] > r2 * (1 - 1e-12)]
        if ring >= radius:
            break
        ring = min(radius, 4 * ring)
    return best, key


def finite(axes) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(a)) < float("inf"), F.lit(False)) for a in axes])


def _dealt(rows: DataFrame, side: float, reach: float, axes) -> DataFrame:
    """``rows`` with ``t_<axis>``, once for each tile that they are at most ``reach`` away from."""
    for a in axes:
        off = reach * (1 + SLACK) + ULPS * F.abs(F.col(a)) if reach else F.lit(0.0)
        rows = rows.withColumn(f"t_{a}", F.explode(F.sequence(F.floor((F.col(a) - off) / side), F.floor((F.col(a) + off) / side))))
    return rows


def by_tiles(asking: DataFrame, there: DataFrame | None, radius: float, axes, found: Callable[[pa.Table, pa.Table], pa.Table], schema: str, plain: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``found`` makes of the rows of ``asking`` in each tile and those of ``there`` that are at most ``radius`` away from the tile; None: of the same rows. All are ``finite``.

    Tiles are as large as holds TILE points on average. A tile with more than MOST, those around it included, is cut into smaller ones; what has more even in tiles of half the radius goes to ``plain``.
    """
    spark = asking.sparkSession
    tiles = [f"t_{a}" for a in axes]
    every = asking if there is None else there
    size = every.agg(F.count("*").alias("n"), F.approx_count_distinct(F.struct(*(F.floor(F.col(a) / radius) for a in axes))).alias("cells")).first()
    wanted = min(TILE, max(500, size["n"] // (4 * spark.sparkContext.defaultParallelism)))
    side = radius * max(1.0, (wanted * max(size["cells"], 1) / max(size["n"], 1)) ** (1 / len(axes)))
    tasks = max(2 * spark.sparkContext.defaultParallelism, size["n"] // 500_000)

    def run(rows: pa.Table) -> pa.Table:
        role = rows.column("_role").to_numpy()
        return found(rows.filter(pa.array((role & ASKS) > 0)), rows.filter(pa.array((role & COUNTS) > 0)))

    out, left = [], asking
    while True:
        if there is None:
            own = reduce(lambda a, b: a & b, [F.floor(F.col(a) / side) == F.col(f"t_{a}") for a in axes])
            # a row asks in its own tile only, and if it is still left
            rows = _dealt(every, side, radius, axes).withColumn("_role", F.when(own, ASKS | COUNTS).otherwise(COUNTS))
        else:
            rows = _dealt(there, side, radius, axes).withColumn("_role", F.lit(COUNTS))
        if there is not None or out:
            rows = rows.withColumn("_role", F.lit(COUNTS)).unionByName(_dealt(left, side, 0.0, axes).withColumn("_role", F.lit(ASKS)), allowMissingColumns=True)
        full = written(rows.groupBy(*tiles).agg(F.count("*").alias("_n")).where(F.col("_n") > MOST).select(*tiles), "full")
        some = not full.isEmpty()
        light = rows.join(F.broadcast(full), tiles, "left_anti") if some else rows  # fewer than the points over MOST, times the tiles a point is in
        out.append(light.repartition(tasks, *tiles).groupBy(*tiles).applyInArrow(run, schema))
        if not some:
            break
        left = written(_dealt(left, side, 0.0, axes).join(F.broadcast(full), tiles, "left_semi").drop(*tiles), "left")
        side /= 2
        if side < radius / 2:
            out.append(plain(left))
            break
    return reduce(DataFrame.union, out)
