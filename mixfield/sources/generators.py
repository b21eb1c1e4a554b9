"""Synthetic points with known components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixfield.operators.metrics import weighted_means
from mixfield.operators.spatial import XY


def uniform(*key: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and seed alone, the same wherever the row is: 32 bits of their MD5."""
    return F.conv(F.substring(drawn_order(*key, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def drawn_order(*key: Column | str, seed: int) -> Column:
    """A text that puts keys into an order drawn with ``seed``."""
    return F.md5(F.concat_ws("|", F.lit(seed), *key).cast("binary"))


def centred(points: DataFrame, source: str = "source", axes=XY) -> DataFrame:
    """Points less the precision-weighted mean of their source."""
    means = weighted_means(points, source, axes)
    rows = points.join(means, source)
    return rows.withColumns({a: F.col(a) - F.col(f"mu{a}") for a in axes}).drop(*(f"mu{a}" for a in axes))


def two_sources(points: DataFrame, first, second, distance: float, delay: int = 0, source: str = "source") -> DataFrame:
    """Two sources, recentred, the second moved by ``distance`` along x and ``delay`` frames; ``truth`` is 0 or 1."""
    rows = centred(points.where(F.col(source).isin(first, second)), source)
    other = F.col(source) == second
    rows = rows.withColumn("x", F.col("x") + F.when(other, distance).otherwise(0.0)).withColumn("truth", F.when(other, 1).otherwise(0).cast("long"))
    return rows.withColumn("frame", F.col("frame") + F.when(other, delay).otherwise(0)) if "frame" in rows.columns else rows


def grid_of_sources(points: DataFrame, n: int, pitch: float, seed: int, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Copies of sources, recentred, on an n by n grid; which source a place gets is drawn with ``seed``.

    Returns the points with ``truth`` (the place's number) and ``truth, mux, muy`` of the places.
    """
    spark = points.sparkSession
    kinds = points.select(source).distinct()
    order = kinds.select(source, drawn_order(source, seed=seed).alias("h")).orderBy("h", source).limit(n * n).collect()  # n * n names at most
    names = [r[source] for r in order]
    if not names:
        raise ValueError("there is no source")
    places = spark.range(n * n).select(F.col("id").alias("truth"), (F.col("id") % n * pitch).cast("double").alias("mux"), (F.floor(F.col("id") / n) * pitch).cast("double").alias("muy"))
    pick = F.floor(uniform("truth", seed=seed + 1) * len(names)).cast("int")
    drawn = places.withColumn(source, F.array(*map(F.lit, names))[pick])
    rows = centred(points.drop("truth") if source != "truth" else points, source).join(F.broadcast(drawn), source)  # n * n places
    return rows.withColumn("x", F.col("x") + F.col("mux")).withColumn("y", F.col("y") + F.col("muy")).drop("mux", "muy"), places


def with_noise(points: DataFrame, share: float, seed: int, pad: tuple[float, float] | None = None, axes=XY) -> DataFrame:
    """Points and about ``share`` times as many uniform ones in their bounding box, padded by ``pad`` or half its size; ``truth`` is -1 for these.

    Whether a point also gives a noise point, and where that lies, depends on its id and ``seed`` alone, so reruns agree. The noise point has
    the variances of the point that gave it and a negative id.
    """
    box = points.agg(*(f(a).alias(f"{n}_{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))))
    rows = points.where(uniform("id", seed=seed) < share).crossJoin(F.broadcast(box))  # one row
    for k, a in enumerate(axes):
        wide = F.lit(pad[k]) if pad else (F.col(f"hi_{a}") - F.col(f"lo_{a}")) / 2
        rows = rows.withColumn(a, F.col(f"lo_{a}") - wide + uniform("id", seed=seed + 1 + k) * (F.col(f"hi_{a}") - F.col(f"lo_{a}") + 2 * wide))
    noise = rows.withColumn("id", -1 - F.col("id")).withColumn("truth", F.lit(-1).cast("long")).select(*points.columns, *([] if "truth" in points.columns else ["truth"]))
    have = points if "truth" in points.columns else points.withColumn("truth", F.lit(0).cast("long"))
    return have.unionByName(noise)


def one_hot(points: DataFrame, components: int) -> DataFrame:
    """``id, z0, z1, ...``: noise first, then each of the components."""
    return points.select("id", *((F.col("truth") == k).cast("int").alias(f"z{k + 1}") for k in range(-1, components)))


def gaussian_grid(spark, n: int, per_centre: int, pitch: float = 50.0, s2: float = 25.0, seed: int = 7) -> DataFrame:
    """``per_centre`` points around each place of an n by n grid, with normal errors of variance ``s2``."""
    rows = spark.range(n * n * per_centre).withColumn("truth", F.floor(F.col("id") / per_centre).cast("long"))
    normal = lambda k: F.sqrt(-2 * F.ln(1 - uniform("id", seed=seed + k))) * F.cos(6.283185307179586 * uniform("id", seed=seed + k + 1))
    place = {"x": F.col("truth") % n * pitch, "y": F.floor(F.col("truth") / n) * pitch}
    return rows.select("id", "truth", *((place[a] + normal(10 * i) * s2**0.5).alias(a) for i, a in enumerate(XY)), *(F.lit(float(s2)).alias(f"s2{a}") for a in XY))
