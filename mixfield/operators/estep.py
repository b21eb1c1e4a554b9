"""Responsibilities of components for points (the local step)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixfield.functions.special import LN_2PI, digamma, digamma_value, e_log_n
from mixfield.operators.spatial import XY, packed
from mixfield.operators.storage import dealt_out

NOISE = -1
#: Responsibility from which a point belongs to a component.
BELONGING = 0.4
#: Log weights this far below a point's best one count as 0 in the sparse step.
UNDERFLOW = -50.0


def noise_logit(logp0, a=None, b=None, pi1=None):
    """Log weight of noise: from the Beta posterior (a, b) of its share, or from a fixed share ``pi1``. Numbers or columns."""
    if pi1 is not None:
        return F.ln(F.lit(pi1) / (1 - F.lit(pi1))) + logp0
    return digamma(F.lit(a) if not isinstance(a, Column) else a) - digamma(F.lit(b) if not isinstance(b, Column) else b) + logp0


def noise_logit_value(logp0: float, s) -> float:
    """``noise_logit`` as a number, for scalars with a posterior (a, b) or a fixed share."""
    if s.pi1 is not None:
        return math.log(s.pi1 / (1 - s.pi1)) + logp0
    return digamma_value(s.a) - digamma_value(s.b) + logp0


def with_number(rows: DataFrame, name: str, value: float) -> DataFrame:
    """``rows`` with a number that comes as a table of one row: so the code that Spark compiles for a step is that of the step before."""
    return rows.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(float(value),)], f"{name} double")))


def component_columns(axes=XY) -> list[str]:
    return ["c", *(f"mu{a}" for a in axes), *(f"v{a}" for a in axes), "log_weight"]


def point_columns(axes=XY) -> list[str]:
    return ["id", *axes, *(f"s2{a}" for a in axes)]


def log_density(k: Column, axes=XY) -> Column:
    """Log weight of the component ``k`` (a struct) for the point of the row."""
    return k["log_weight"] + e_log_n([F.col(a) for a in axes], [F.col(f"s2{a}") for a in axes], [k[f"mu{a}"] for a in axes], [k[f"v{a}"] for a in axes])


def _beside(points: DataFrame, components: DataFrame, axes, *more: str) -> tuple[DataFrame, Column]:
    """Every point beside every component, and the log density without the component's weight; rows come one after the other, and neither side is an array or shuffled by pairs."""
    base = reduce(lambda total, a: total - 0.5 * F.ln(f"s2{a}"), axes, F.lit(-0.5 * LN_2PI * len(axes)))
    rows = dealt_out(points.select(*point_columns(axes), *more)).withColumn("_base", base)
    both = rows.crossJoin(F.broadcast(components.select(*component_columns(axes))))
    away = [((F.col(a) - F.col(f"mu{a}")) * (F.col(a) - F.col(f"mu{a}")) + F.col(f"v{a}")) / (2 * F.col(f"s2{a}")) for a in axes]
    return both, reduce(lambda total, d: total - d, away, F.col("_base"))


def log_likelihood(points: DataFrame, components: DataFrame, axes=XY) -> DataFrame:
    """``id, c, logp`` of every point and component, without the components' weights."""
    both, logp = _beside(points, components.withColumn("log_weight", F.lit(0.0)), axes)
    return both.select("id", "c", logp.alias("logp"))


def every_pair(points: DataFrame, components: DataFrame, logit: float, axes=XY) -> DataFrame:
    """``dense`` for any number of components, of points with ``_total``, the log of the sum of their weights (see ``near.with_totals``).

    Noise is a row among the components, so a filter by ``c`` leaves out components before any pair is made.
    """
    noise = points.sparkSession.range(1).select(*((F.lit(NOISE).cast("long") if n == "c" else F.lit(float(logit)) if n == "log_weight" else F.lit(0.0)).alias(n) for n in component_columns(axes)))
    both, density = _beside(points, components.select(*component_columns(axes)).unionByName(noise), axes, "_total")
    logp = F.when(F.col("c") == NOISE, F.col("log_weight")).otherwise(F.col("log_weight") + density)
    return both.select(*point_columns(axes), "c", logp.alias("logp"), F.exp(logp - F.col("_total")).alias("r"))


def rounded(value: Column, digits: int) -> Column:
    """``value`` to so many digits, halves away from 0, without a decimal for each; others than the usual numbers as ``round`` has them."""
    scale = 10.0**digits
    size = F.floor(F.abs(value) * scale + 0.5).cast("double") / scale
    return F.when(F.abs(value) * scale < 1e15, F.when(value < 0, -size).otherwise(size)).otherwise(F.round(value, digits))


def dense(points: DataFrame, components: DataFrame, logit: Column, axes=XY) -> DataFrame:
    """``id, c, logp, r`` and the point's columns for noise (c = -1) and each of ``components``.

    The components travel as one row of arrays (at most ``spatial.MAX_PACKED``), and a point's weights are an array until they are normalized, so
    points are not shuffled and the points times components rows exist only from there on.
    """
    rows = points.select(*point_columns(axes)).crossJoin(F.broadcast(packed(components, component_columns(axes))))
    logs = F.concat(F.array(logit.cast("double")), F.transform("centres", lambda k: log_density(k, axes)))
    rows = rows.withColumn("logs", logs).withColumn("total", log_sum(F.col("logs")))
    ids = F.concat(F.array(F.lit(NOISE).cast("long")), F.transform("centres", lambda k: k["c"].cast("long")))
    pairs = rows.select(*point_columns(axes), "total", F.explode(F.arrays_zip(ids.alias("c"), F.col("logs").alias("logp"))).alias("k"))
    return pairs.select(*point_columns(axes), F.col("k.c").alias("c"), F.col("k.logp").alias("logp"), F.exp(F.col("k.logp") - F.col("total")).alias("r"))


def near_pairs(points: DataFrame, components: DataFrame, radius: float, axes=XY) -> DataFrame:
    """Pairs of a point and a component nearer than ``radius`` times the point's root mean variance, without a cross join.

    Points are put into classes by the power of two above their radius, and each class is joined on a grid of its own size, so a few
    uncertain points don't coarsen the grid of all others. Components are repeated for every class that occurs.
    """
    left, levels, cells = _classed(points.select(*point_columns(axes)), radius, axes)
    centre = _around(components.select(*component_columns(axes)), levels, cells, axes)
    d2 = reduce(lambda a, b: a + b, [(F.col(a) - F.col(f"mu{a}")) ** 2 for a in axes])
    return left.join(centre, ["level", *cells]).where(d2 < F.col("reach2")).drop("reach2", "level", *cells)


def _classed(points: DataFrame, radius: float, axes) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points with ``reach2``, ``level`` and cells of their level's size; the levels that occur; the names of the cells."""
    mean = reduce(lambda a, b: a + b, [F.col(f"s2{a}") for a in axes]) / len(axes)
    reach = F.lit(radius) * F.sqrt(mean)
    rows = points.withColumn("reach2", reach * reach).withColumn("level", F.ceil(F.log2(reach)).cast("int"))
    cells = [f"cell_{a}" for a in axes]
    size = F.pow(F.lit(2.0), F.col("level"))
    return rows.withColumns({c: F.floor(F.col(a) / size) for c, a in zip(cells, axes, strict=True)}), rows.select("level").distinct(), cells


def _around(components: DataFrame, levels: DataFrame, cells: list[str], axes) -> DataFrame:
    """Components in the cells around their own, for every level; a level for each power of two."""
    size = F.pow(F.lit(2.0), F.col("level"))
    rows = components.crossJoin(F.broadcast(levels)).withColumns({c: F.floor(F.col(f"mu{a}") / size) for c, a in zip(cells, axes, strict=True)})
    for c in cells:
        rows = rows.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    return rows


def sparse(points: DataFrame, components: DataFrame, logit: Column, radius: float = 4.0, axes=XY) -> DataFrame:
    """As ``dense``, with only the components that are near a point (see ``near_pairs``) and its noise row.

    For any number of components: those near a cell come to its points as an array, and a point's weights are normalized in its row, so
    pairs are never shuffled. Log weights 50 below the best of a point give 0.
    """
    own = point_columns(axes)
    left, levels, cells = _classed(points.select(*own), radius, axes)
    there = _around(components.select(*component_columns(axes)), levels, cells, axes).groupBy("level", *cells).agg(F.collect_list(F.struct(*component_columns(axes))).alias("ks"))
    rows = left.join(there, ["level", *cells], "left")
    d2 = lambda k: reduce(lambda a, b: a + b, [(F.col(a) - k[f"mu{a}"]) ** 2 for a in axes])
    near = F.filter(F.coalesce("ks", F.array()), lambda k: d2(k) < F.col("reach2"))
    return normalized(rows, own, near, logit, axes, UNDERFLOW)


def log_sum(logs: Column, start: Column | None = None, finish=lambda s: s["m"] + F.ln(s["s"])) -> Column:
    """``ln sum exp`` of an array of numbers, and of ``start`` if given, in one pass: with the largest so far and the sum relative to it."""
    first = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s")) if start is None else F.struct(start.cast("double").alias("m"), F.lit(1.0).alias("s"))
    more = lambda s, v: F.when(v > s["m"], F.struct(v.alias("m"), (s["s"] * F.exp(s["m"] - v) + 1.0).alias("s"))).otherwise(F.struct(s["m"].alias("m"), (s["s"] + F.exp(v - s["m"])).alias("s")))
    return F.aggregate(logs, first, more, finish)


def normalized(rows: DataFrame, own: list[str], centres: Column, logit: Column, axes=XY, cut: float | None = None) -> DataFrame:
    """``c, logp, r`` and the columns ``own`` for noise and each of a row's array of components, normalized within the row; what is ``cut`` below the best of a row has 0.

    The array is a variable of the outer lambda, so it is made once, and one pass over it gives the sum; the weights come after it is exploded, in compiled code.
    """
    both = lambda s: F.struct(s["m"].alias("top"), (s["m"] + F.ln(s["s"])).alias("total"))
    sums = lambda ks: log_sum(F.transform(ks, lambda k: log_density(k, axes)), logit, both)
    noise = F.struct(*((F.lit(NOISE).cast("long") if n == "c" else F.lit(1.0)).alias(n) for n in component_columns(axes)))
    named = lambda k: F.struct(*((k[n].cast("long") if n == "c" else k[n].cast("double")).alias(n) for n in component_columns(axes)))
    one = F.transform(F.array(centres), lambda ks: F.struct(sums(ks).alias("sums"), F.concat(F.array(noise), F.transform(ks, named)).alias("ks")))[0]
    rows = rows.select(*own, logit.cast("double").alias("_noise"), one.alias("_one"))
    rows = rows.select(*own, "_noise", F.col("_one.sums").alias("_sums"), F.explode("_one.ks").alias("_k"))
    logp = F.when(F.col("_k.c") == NOISE, F.col("_noise")).otherwise(log_density(F.col("_k"), axes))
    rows = rows.select(*own, F.col("_k.c").alias("c"), logp.alias("logp"), "_sums")
    weight = F.exp(F.col("logp") - F.col("_sums.total"))
    return rows.select(*own, "c", "logp", (weight if cut is None else F.when(F.col("logp") - F.col("_sums.top") < cut, 0.0).otherwise(weight)).alias("r"))


def softmax(rows: DataFrame, cut: float | None = None, clip: float | None = None) -> DataFrame:
    """Adds ``r``: ``logp`` normalized over the rows of an ``id``, with values ``cut`` below the largest as 0 and differences clipped to ``clip``."""
    own = Window.partitionBy("id")
    shifted = F.col("logp") - F.max("logp").over(own)
    if clip is not None:
        shifted = F.greatest(F.least(shifted, F.lit(clip)), F.lit(-clip))
    weight = F.exp(shifted) if cut is None else F.when(shifted < cut, 0.0).otherwise(F.exp(shifted))
    return rows.withColumn("_w", weight).withColumn("r", F.col("_w") / F.sum("_w").over(own)).drop("_w")


def responsibilities_of(points: DataFrame, resp: DataFrame, c: int) -> DataFrame:
    """``id, r`` of one component for every point, 0 where it has none."""
    return points.select("id").join(resp.where(F.col("c") == c).select("id", "r"), "id", "left").na.fill(0.0, ["r"])


def members(resp: DataFrame, at_least: float = BELONGING) -> DataFrame:
    return resp.where((F.col("c") != NOISE) & (F.col("r") > at_least))


def noise_points(resp: DataFrame, at_least: float = 0.5) -> DataFrame:
    return resp.where((F.col("c") == NOISE) & (F.col("r") > at_least))


def split_candidates(resp: DataFrame, component: DataFrame, c: int, radius: float = 50.0, axes=XY) -> DataFrame:
    """Points that belong to component ``c``, or are noise within ``radius`` of its mean in ``component`` (its row)."""
    centre = F.broadcast(component.where(F.col("c") == c).select(*(F.col(f"mu{a}").alias(f"_mu{a}") for a in axes)))  # one row
    d2 = reduce(lambda a, b: a + b, [(F.col(a) - F.col(f"_mu{a}")) ** 2 for a in axes])
    own = resp.where((F.col("r") > BELONGING) & F.col("c").isin(c, NOISE)).crossJoin(centre)
    return own.where((F.col("c") == c) | (d2 <= radius * radius)).select(*point_columns(axes)).distinct()


def entropy(resp: DataFrame, least: float = 1e-10) -> DataFrame:
    """One row ``entropy``: the sum of r ln r of noise and components alike, without values below ``least``."""
    return resp.where(F.col("r") >= least).agg(F.coalesce(F.sum(F.col("r") * F.ln("r")), F.lit(0.0)).alias("entropy"))


def ragged(resp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists of ``(c, r)`` by point and of ``(id, r)`` by component, for export."""
    by_point = resp.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "r"))).alias("components"))
    return by_point, resp.where(F.col("c") != NOISE).select("c", "id", "r")


