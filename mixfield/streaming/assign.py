"""Assignment of a stream of points to a model that no longer changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixfield.operators.estep import NOISE, component_columns, log_density
from mixfield.operators.spatial import XY, packed, with_cells


def assign(points: DataFrame, components: DataFrame, logit: Column, axes=XY, radius: float | None = None) -> DataFrame:
    """Adds ``c`` and ``r``, the component (or noise) with the largest responsibility, to a stream or table of points.

    The components travel as one row, so a stream needs no state and no shuffle. With a ``radius``, for any number of components: those in the grid cells around a point's own, which are at least
    as wide, come to it by a join with a table of arrays.
    """
    if radius is None:
        rows, centres = points.crossJoin(F.broadcast(packed(components, component_columns(axes)))), F.col("centres")
    else:
        cells = [f"cell_{a}" for a in axes]
        there = with_cells(components.select(*component_columns(axes), *(F.col(f"mu{a}").alias(a) for a in axes)), radius, axes, halo=True)
        there = there.groupBy(*cells).agg(F.sort_array(F.collect_list(F.struct(*component_columns(axes)))).alias("centres"))
        rows, centres = with_cells(points, radius, axes).join(there, cells, "left"), F.coalesce("centres", F.array())
    # one pass: the best so far, and the sum relative to it
    start = F.struct(logit.cast("double").alias("l"), F.lit(NOISE).cast("long").alias("c"), F.lit(1.0).alias("s"))

    def more(best: Column, v: Column) -> Column:
        better = (v["l"] > best["l"]) | ((v["l"] == best["l"]) & (v["c"] > best["c"]))
        new = F.struct(v["l"].alias("l"), v["c"].alias("c"), (best["s"] * F.exp(best["l"] - v["l"]) + 1.0).alias("s"))
        return F.when(better, new).otherwise(F.struct(best["l"].alias("l"), best["c"].alias("c"), (best["s"] + F.exp(v["l"] - best["l"])).alias("s")))

    logs = F.transform(centres, lambda k: F.struct(log_density(k, axes).alias("l"), k["c"].cast("long").alias("c")))
    rows = rows.withColumn("_best", F.aggregate(logs, start, more))
    return rows.select(*points.columns, F.col("_best.c").alias("c"), (1.0 / F.col("_best.s")).alias("r"))


def frame_counts(assigned: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """``start, c, n``: points of a component by window of event time, for streams with late points."""
    rows = assigned.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "c").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "c", "n")


