"""Points and centres as views of tables, and priors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixfield.operators.mstep import running_sums
from mixfield.operators.order import numbered
from mixfield.operators.spatial import XY


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_points(spark: SparkSession, folder: str) -> DataFrame:
    """Events as points with a frame: one frame an hour, value and user as position."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("int").alias("frame"),
        F.col("value").alias("x"),
        (F.col("user_id") * 3.0).alias("y"),
        (4.0 + 0.1 * k).alias("s2x"),
        (4.0 + 0.1 * k).alias("s2y"),
    )


def embedding_points(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as 3-D points with a true component."""
    at = lambda i: (F.col("embedding")[i].cast("double") * 1000.0)
    s2 = [(100.0 + F.col("label")).cast("double").alias(f"s2{a}") for a in "xyz"]
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), *s2, F.col("label").cast("long").alias("truth"))


def order_points(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice").cast("double") / 1000).alias("x"), (F.col("o_custkey") * 0.1).cast("double").alias("y"), F.lit(4.0).alias("s2x"), F.lit(4.0).alias("s2y"))


def lineitem_points(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as points; ``id`` is a hash, since no columns tell all rows apart."""
    rows = table(spark, folder, "lineitem")
    return rows.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        (F.col("l_extendedprice").cast("double") / 100).alias("x"),
        (F.col("l_quantity").cast("double") * 20).alias("y"),
        (4 + 100 * F.col("l_discount").cast("double")).alias("s2x"),
        (4 + 100 * F.col("l_tax").cast("double")).alias("s2y"),
    )


def cell_centres(points: DataFrame, pitch: float = 50.0, alpha0: float = 10.0, axes=XY) -> DataFrame:
    """A centre for each grid cell with points: their mean, mean variance and count, numbered in order of the cells."""
    cells = [f"cell_{a}" for a in axes]
    placed = points.select(*(F.floor(F.col(a) / pitch).alias(c) for a, c in zip(axes, cells, strict=True)), *axes, *(f"s2{a}" for a in axes))
    found = placed.groupBy(*cells).agg(*(F.avg(a).alias(f"mu{a}") for a in axes), *(F.avg(f"s2{a}").alias(f"v{a}") for a in axes), F.count("*").alias("n"))
    rows = numbered(found, "c", *cells).withColumn("c", F.col("c").cast("long"))
    return with_counts(rows.select("c", *(f"mu{a}" for a in axes), *(f"v{a}" for a in axes), "n"), alpha0)


def with_counts(rows: DataFrame, alpha0: float = 10.0) -> DataFrame:
    """Adds ``eta1 = 1 + n`` and ``eta0 = alpha0`` plus the counts of all later centres."""
    rows = running_sums(rows.withColumn("eta1", 1.0 + F.col("n")), "n", "_after", True)
    return rows.withColumn("eta0", F.lit(float(alpha0)) + F.col("_after")).drop("_after")


def prior_scalars(points: DataFrame, axes=XY) -> DataFrame:
    """One row: count, area, mean position, variance of centres, log density of noise and mean error of the points."""
    area = (F.max(axes[0]) - F.min(axes[0])) * (F.max(axes[1]) - F.min(axes[1]))
    s2 = sum((F.avg(f"s2{a}") for a in axes), F.lit(0.0)) / len(axes)
    one = points.agg(F.count("*").alias("n"), area.alias("area"), *(F.avg(a).alias(f"mu0{a}") for a in axes), F.sqrt(s2).alias("mean_sigma"))
    return one.withColumn("sigma02", F.col("area") * F.col("area")).withColumn("logp0", -1.5 * F.ln("area"))


#: Parameters of the priors that don't depend on the points.
DEFAULTS = {"pi1": 0.1, "a": 1.0, "b": 10.0, "alpha0": 10.0, "gamma1": 1.0, "gamma2": 0.01}


def priors(points: DataFrame, axes=XY, **own) -> dict:
    """The priors as numbers, with ``own`` in place of defaults."""
    row = prior_scalars(points, axes).first().asDict()
    if not row["n"] or not row["area"]:
        row |= {"area": 1.0, "sigma02": 1.0, "logp0": 0.0}
    return DEFAULTS | {k: 0.0 if v is None or math.isnan(v) else v for k, v in row.items()} | own
