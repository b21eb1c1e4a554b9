"""Readers and writers of points, centres and model snapshots."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixfield.operators.spatial import XY

#: Data sets by name: a function of (spark, path) that gives points.
DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def dataset(name: str):
    def add(read):
        DATASETS[name] = read
        return read

    return add


def read_dataset(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name}; there are {', '.join(sorted(DATASETS))}")
    return DATASETS[name](spark, path)


def _numbered(df: DataFrame) -> DataFrame:
    return df if "id" in df.columns else df.withColumn("id", F.monotonically_increasing_id())


@dataset("origami-af647")
def origami_af647(spark: SparkSession, path: str) -> DataFrame:
    """Columns 0 to 2 are frame and position; a tenth of the square of column 8 is the variance. One folder ``dataset_id=...`` for each table."""
    raw = spark.read.parquet(path)
    s2 = F.col("_8") * F.col("_8") / 10
    return _numbered(raw).select("id", *([c for c in raw.columns if c == "dataset_id"]), F.col("_0").cast("int").alias("frame"), F.col("_1").alias("x"), F.col("_2").alias("y"), s2.alias("s2x"), s2.alias("s2y"))


@dataset("origami-dynein")
def origami_dynein(spark: SparkSession, path: str) -> DataFrame:
    """Columns 1 to 3 are frame and position; the square of column 9 is the variance."""
    raw = spark.read.parquet(path)
    s2 = F.col("_9") * F.col("_9")
    return _numbered(raw).select("id", *([c for c in raw.columns if c == "dataset_id"]), F.col("_1").cast("int").alias("frame"), F.col("_2").alias("x"), F.col("_3").alias("y"), s2.alias("s2x"), s2.alias("s2y"))


@dataset("npc")
def npc(spark: SparkSession, path: str) -> DataFrame:
    """Localizations ``frame, x, y, sx, sy`` with errors as standard deviations."""
    return variances(_numbered(spark.read.parquet(path)))


def variances(rows: DataFrame, axes=XY) -> DataFrame:
    """``s2*`` as squares of the standard deviations ``s*``."""
    return rows.withColumns({f"s2{a}": F.col(f"s{a}") * F.col(f"s{a}") for a in axes}).drop(*(f"s{a}" for a in axes))


def read_columns(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",") -> DataFrame:
    """Some columns of a CSV file with a header, as strings."""
    return spark.read.option("sep", delimiter).option("header", True).csv(path).select(*columns)


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """``line, v`` of a text file of numbers; ``line`` rises with the place in the file."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    return lines.select("line", F.transform(F.split(F.trim("value"), r"\s+"), lambda v: v.cast("double")).alias("v"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a text file: a line with their number, then ``x y s2x s2y`` each. ``id`` counts them from 0."""
    rows = _numbers(spark, path).where(F.size("v") == 4)
    return _in_order(rows).select("id", *(F.col("v")[i].alias(n) for i, n in enumerate(("x", "y", "s2x", "s2y"))))


def read_centres(spark: SparkSession, path: str, points: DataFrame) -> DataFrame:
    """Centres of a text file: a line with their number, then the id of a point each."""
    rows = _in_order(_numbers(spark, path), skip=1).select(F.col("id").alias("c"), F.col("v")[0].cast("long").alias("point"))
    return rows.join(points, rows.point == points.id).select("c", F.col("x").alias("mux"), F.col("y").alias("muy"), F.col("s2x").alias("vx"), F.col("s2y").alias("vy"))


def read_kmeans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Centres ``c, mux, muy`` and points ``id, x, y`` of a text file: a line with both numbers, then a position each."""
    rows = _in_order(_numbers(spark, path))
    n = int(rows.where("id = 0").select(F.col("v")[0]).first()[0])
    centres = rows.where(F.col("id").between(1, n)).select((F.col("id") - 1).alias("c"), F.col("v")[0].alias("mux"), F.col("v")[1].alias("muy"))
    return centres, rows.where(F.col("id") > n).select((F.col("id") - n - 1).alias("id"), F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


def _in_order(rows: DataFrame, skip: int = 0) -> DataFrame:
    """Adds ``id``, the number of the row in order of ``line``: ranks within file partitions, then the sums of those before."""
    part = F.shiftright("line", 33)
    sums = rows.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    sums = sums.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = rows.withColumn("part", part).withColumn("inside", F.row_number().over(Window.partitionBy("part").orderBy("line")) - 1)
    return own.join(sums, own.part == sums.p).select("v", (F.col("before") + F.col("inside") - skip).alias("id")).where("id >= 0")


def in_memory_points(spark: SparkSession, arrays: dict) -> DataFrame:
    """Points of arrays ``x, y, [z,] s2x, s2y, [s2z,] [frame]``; ``id`` counts them unless given."""
    rows = pd.DataFrame(arrays)
    if "id" not in rows:
        rows.insert(0, "id", range(len(rows)))
    return spark.createDataFrame(rows)


def in_memory_components(spark: SparkSession, mu, sigma2, elog_beta, axes=XY) -> DataFrame:
    """Components ``c, mu*, v*, log_weight`` of arrays: means and variances with a row for each component, and expected log shares."""
    mu, sigma2 = pd.DataFrame(mu, columns=[f"mu{a}" for a in axes]), pd.DataFrame(sigma2, columns=[f"v{a}" for a in axes])
    if not len(mu) == len(sigma2) == len(elog_beta):
        raise ValueError(f"{len(mu)} means, {len(sigma2)} variances and {len(elog_beta)} shares")
    rows = pd.concat([mu, sigma2], axis=1).astype(float).assign(log_weight=[float(x) for x in elog_beta])
    rows.insert(0, "c", range(len(rows)))
    kinds = ", ".join(f"{c} {'long' if c == 'c' else 'double'}" for c in rows.columns)
    return spark.createDataFrame(rows.values.tolist() if rows.empty else [(int(r[0]), *r[1:]) for r in rows.itertuples(index=False, name=None)], kinds)


def detect(width: int) -> tuple[str, ...]:
    """Names of the columns of an observation matrix with so many columns."""
    kinds = {4: "x y s2x s2y", 6: "x y z s2x s2y s2z", 5: "frame x y s2x s2y", 7: "frame x y z s2x s2y s2z"}
    if width not in kinds:
        raise ValueError(f"observations have 4 to 7 columns, not {width}")
    return tuple(kinds[width].split())


def save_model(components: DataFrame, scalars: dict, path: str) -> None:
    """A snapshot of a model: its components, and its numbers as one row."""
    components.write.mode("overwrite").parquet(f"{path}/components")
    components.sparkSession.createDataFrame([scalars]).write.mode("overwrite").parquet(f"{path}/scalars")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/components"), spark.read.parquet(f"{path}/scalars").first().asDict()


def dump_state(points: DataFrame, components: DataFrame, resp: DataFrame, path: str) -> None:
    """Points, components and responsibilities as JSON lines, numbers rounded to four digits."""
    for name, df in (("points", points), ("components", components), ("responsibilities", resp)):
        short = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        df.select(*short).write.mode("overwrite").json(f"{path}/{name}")
