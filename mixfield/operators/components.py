"""Insertion, removal, merging and splitting of components, in the components table and the responsibilities alike."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixfield.operators.estep import NOISE, point_columns
from mixfield.operators.spatial import XY


def require(df: DataFrame, **types: str) -> DataFrame:
    """``df`` if it has all the columns with the given types; ``ValueError`` otherwise."""
    have = dict(df.dtypes)
    wrong = {k: (t, have.get(k)) for k, t in types.items() if have.get(k) != t}
    if wrong:
        raise ValueError("; ".join(f"{k}: {want} is needed, not {got}" for k, (want, got) in wrong.items()))
    return df


def append_empty(components: DataFrame, n: int = 1) -> DataFrame:
    """``n`` components with zeros after all others."""
    zeros = [F.lit(0).cast(t).alias(c) for c, t in components.dtypes if c != "c"]
    last = components.agg(F.coalesce(F.max("c"), F.lit(-1)).alias("last"))
    more = components.sparkSession.range(n).crossJoin(F.broadcast(last)).select((F.col("last") + 1 + F.col("id")).cast(dict(components.dtypes)["c"]).alias("c"), *zeros)
    return components.unionByName(more)


def insert_from_noise(resp: DataFrame, ids: DataFrame) -> DataFrame:
    """Responsibilities with a new component 0: the noise of the points ``ids(id)`` becomes its own, and all others move up by one."""
    chosen = ids.select("id").distinct().withColumn("_new", F.lit(True))
    # only rows of noise are joined
    noise = resp.where(F.col("c") == NOISE).join(chosen, "id", "left").withColumn("c", F.when(F.col("_new"), F.lit(0)).otherwise(F.lit(NOISE)).cast("long"))
    up = resp.where(F.col("c") != NOISE).withColumn("c", (F.col("c") + 1).cast("long"))
    return up.unionByName(noise.select(*resp.columns))


def insert_front(components: DataFrame, centre: DataFrame) -> DataFrame:
    """Components with the row of ``centre`` as number 0 and the others moved up by one."""
    moved = components.withColumn("c", F.col("c") + 1)
    return moved.unionByName(centre.withColumn("c", F.lit(0).cast("long")).select(*components.columns))


#: Up to so many numbers are compared one by one in an expression, more are joined as a table.
FEW = 16


def renumber(rows: DataFrame, gone: list[int]) -> DataFrame:
    """Rows without the components ``gone``, and with the numbers after them moved down."""
    gone = sorted(set(gone))
    if not gone:
        return rows
    if len(gone) <= FEW:
        below = sum((F.when(F.col("c") > g, 1).otherwise(0) for g in gone), F.lit(0))
        return rows.where(~F.col("c").isin(gone)).withColumn("c", (F.col("c") - below).cast("long"))
    # one row for each component up to the last that goes
    going = np.zeros(gone[-1] + 1, bool)
    going[gone] = True
    before = np.arange(len(going))
    moved = pa.table({"_from": pa.array(before), "_to": pa.array(before - np.cumsum(going), mask=going)})
    table = rows.sparkSession.createDataFrame(moved, "_from long, _to long")
    found = rows.join(table, rows.c == F.col("_from"), "left").where("_from is null or _to is not null")
    noise = F.when(F.col("c") == NOISE, F.col("c"))
    return found.withColumn("c", F.coalesce(noise, "_to", F.col("c") - len(gone)).cast("long")).select(*rows.columns)


def remove(resp: DataFrame, gone: list[int], axes=XY) -> DataFrame:
    """Responsibilities without the components ``gone``, whose part goes to noise; a point's rows still add up to 1."""
    if not gone:
        return resp
    if min(gone) < 0:
        raise ValueError("noise can't be removed")
    return _joined(resp, [NOISE, *gone], NOISE, gone, axes)


def merge(resp: DataFrame, k1: int, k2: int, axes=XY) -> DataFrame:
    """Responsibilities with ``k2`` added to ``k1 < k2`` and later components moved down."""
    if not 0 <= k1 < k2:
        raise ValueError("the first component must come before the second")
    return _joined(resp, [k1, k2], k1, [k2], axes)


def _joined(resp: DataFrame, which: list[int], to: int, gone: list[int], axes) -> DataFrame:
    """The rows of ``which`` added up as ``to``, and all others as they are, with numbers after ``gone`` moved down: only rows that change are grouped."""
    own = [*point_columns(axes), "c", "r"]
    few = len(which) <= FEW
    table = None if few else F.broadcast(resp.sparkSession.createDataFrame(pa.table({"c": pa.array(which, pa.int64())}), "c long"))
    some = resp.where(F.col("c").isin(which)) if few else resp.join(table, "c", "left_semi")
    rest = resp.where(~F.col("c").isin(which)) if few else resp.join(table, "c", "left_anti")
    added = some.groupBy(*point_columns(axes)).agg(F.sum("r").alias("r")).withColumn("c", F.lit(to).cast("long"))
    return renumber(rest.select(*own), gone).unionByName(renumber(added.select(*own), gone))


def split(resp: DataFrame, k: int, proposed: DataFrame, axes=XY) -> DataFrame:
    """Responsibilities with ``k`` replaced by ``k`` and ``k + 1``, given by ``r1`` and ``r2`` of ``proposed``."""
    own = [*point_columns(axes), "c", "r"]
    rest = resp.where(F.col("c") != k).withColumn("c", F.when(F.col("c") > k, F.col("c") + 1).otherwise(F.col("c")).cast("long")).select(*own)
    parts = [proposed.select(*point_columns(axes), F.lit(k + i).cast("long").alias("c"), F.col(f"r{i + 1}").alias("r")) for i in (0, 1)]
    return rest.unionByName(parts[0]).unionByName(parts[1])
