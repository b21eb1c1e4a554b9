"""Sufficient statistics and the update of the components (the global step)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixfield.functions.special import digamma_array, lgamma_array, log_sticks
from mixfield.operators.estep import NOISE
from mixfield.operators.spatial import XY
from mixfield.operators.storage import written

#: Components of one run are summed in one task.
RUN = 100_000


def running_sums(rows: DataFrame, column: str, out: str, after: bool) -> DataFrame:
    """Adds ``out``: the sum of ``column`` over the components with larger (``after``) or smaller ``c``.

    Sums of runs of ``c`` are added up first, so any number of components can be summed without ordering all in one task. Rows are summed in falling order for ``after``: Spark adds up a frame
    that ends with the last row anew for each row, which takes the square of a run, and one that begins with the first row only once.
    """
    order, span = F.desc if after else F.asc, (Window.unboundedPreceding, -1)
    rows = rows.withColumn("_run", F.floor(F.col("c") / RUN))
    zero = F.lit(0.0)
    runs = rows.groupBy(F.col("_run").alias("_of")).agg(F.sum(column).alias("_sum"))
    runs = runs.select("_of", F.coalesce(F.sum("_sum").over(Window.orderBy(order("_of")).rowsBetween(*span)), zero).alias("_others"))
    inside = F.coalesce(F.sum(column).over(Window.partitionBy("_run").orderBy(order("c")).rowsBetween(*span)), zero)
    rows = rows.withColumn("_inside", inside)
    return rows.join(runs, rows._run == runs._of).withColumn(out, F.col("_inside") + F.col("_others")).drop("_run", "_of", "_others", "_inside")


def stick_weights(components: DataFrame) -> DataFrame:
    """Adds ``elog_u``, ``elog_1mu`` and ``log_weight`` (the expected log share) from ``eta1`` and ``eta0``."""
    u, v = log_sticks(F.col("eta1"), F.col("eta0"))
    rows = components.drop("elog_u", "elog_1mu", "log_weight").withColumn("elog_u", u).withColumn("elog_1mu", v)
    return running_sums(rows, "elog_1mu", "_before", False).withColumn("log_weight", F.col("elog_u") + F.col("_before")).drop("_before")


def sufficient_stats(resp: DataFrame, axes=XY) -> DataFrame:
    """``c, rk, n`` and ``xx*``, ``sx*`` by component, noise included: summed within tasks first, so only a row for each component and task is shuffled."""
    sums = [F.sum(F.col("r") * F.col(a) / F.col(f"s2{a}")).alias(f"xx{a}") for a in axes] + [F.sum(F.col("r") / F.col(f"s2{a}")).alias(f"sx{a}") for a in axes]
    return resp.groupBy("c").agg(F.sum("r").alias("rk"), *sums, F.count("*").alias("n"))


def observed(resp: DataFrame, axes=XY) -> Column:
    """Expression for the sum whose negative half is ``cobs``: over rows of components only."""
    terms = sum(((F.col(a) * F.col(a) / F.col(f"s2{a}") + F.ln(2 * math.pi * F.col(f"s2{a}"))) for a in axes), F.lit(0.0))
    return F.sum(F.when(F.col("c") != NOISE, F.col("r") * terms).otherwise(0.0))


def moved(components: DataFrame, stats: DataFrame, prior: dict, axes=XY) -> DataFrame:
    """``c, mu*, v*, rk``: the new means and variances of ``components(c)`` from ``stats``; those without rows get zeros."""
    rows = components.select("c").join(stats.where(F.col("c") != NOISE), "c", "left").na.fill(0.0)
    v = {a: 1.0 / (F.col(f"sx{a}") + 1.0 / prior["sigma02"]) for a in axes}
    return rows.select("c", *(((F.col(f"xx{a}") + prior[f"mu0{a}"] / prior["sigma02"]) * v[a]).alias(f"mu{a}") for a in axes), *(v[a].alias(f"v{a}") for a in axes), "rk")


def run_of() -> Column:
    return F.floor(F.col("c") / RUN).cast("long")


def offsets(sums: dict[int, float], after: bool) -> dict[int, float]:
    """For each run the sum of the later or earlier ones."""
    out, total = {}, 0.0
    for run in sorted(sums, reverse=after):
        out[run] = total
        total += sums[run]
    return out


def sticks_of_runs(rows: DataFrame, later: dict[int, float], alpha: float, prior: dict, axes=XY) -> DataFrame:
    """Adds ``eta1, eta0, elog_u, elog_1mu``, ``log_weight`` within the run, and ``own`` and ``centre``, a component's parts of the bound, to ``c, mu*, v*, rk``.

    A run of RUN components is a group; ``later`` has for each the counts of the runs after it.
    """
    names = ["c", *(f"mu{a}" for a in axes), *(f"v{a}" for a in axes), "rk", "eta1", "eta0", "elog_u", "elog_1mu", "log_weight", "own", "centre"]
    of_prior = sum(math.log(2 * math.pi * prior["sigma02"]) + prior[f"mu0{a}"] ** 2 / prior["sigma02"] for a in axes)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("c")
        value = {n: rows.column(n).to_numpy() for n in names[: 2 + 2 * len(axes)]}
        eta1 = 1.0 + value["rk"]
        eta0 = alpha + later[key[0].as_py()] + np.append(np.cumsum(value["rk"][::-1])[::-1][1:], 0.0)
        both = digamma_array(eta1 + eta0)
        u, v = digamma_array(eta1) - both, digamma_array(eta0) - both
        weight = u + np.append(0.0, np.cumsum(v)[:-1])
        own = lgamma_array(eta1 + eta0) - lgamma_array(eta1) - lgamma_array(eta0)
        centre = 0.5 * (sum(np.log(2 * math.pi * value[f"v{a}"]) + value[f"mu{a}"] ** 2 / value[f"v{a}"] for a in axes) - of_prior)
        return pa.table([*value.values(), eta1, eta0, u, v, weight, own, centre], names)

    return rows.groupBy(run_of().alias("_run")).applyInArrow(run, "c long, " + ", ".join(f"{n} double" for n in names[1:]))


def update(components: DataFrame, stats: DataFrame, prior: dict, alpha: float, axes=XY, least: float = 0.0) -> tuple[DataFrame, dict]:
    """New ``mu*``, ``v*``, ``eta1``, ``eta0`` and expected logs of ``components(c)`` from ``stats``, as a table, and what the scalars and the bound need of them: ``n``, ``s`` (expected logs), ``own``
    (sticks), ``centres``, ``few`` (how many have less than ``least``), and of the statistics ``r0``, ``r1``, ``entropy`` and ``cobs``.

    ``alpha`` is the concentration from before this step: ``gamma1 / gamma2`` where it is inferred. Of runs only sums come to the driver.
    """
    of = {r["run"]: r for r in stats.groupBy(run_of().alias("run")).agg(F.sum("rk").alias("rk"), F.sum("ent").alias("ent"), F.sum("obs").alias("obs")).collect()}
    rows = moved(components, stats.select("c", "rk", *(f"{p}{a}" for a in axes for p in ("xx", "sx"))), prior, axes)
    # runs without statistics have sums of 0
    runs = {r["run"]: of[r["run"]]["rk"] if r["run"] in of else 0.0 for r in components.select(run_of().alias("run")).distinct().collect()}
    rows = written(sticks_of_runs(rows, offsets(runs, True), float(alpha), prior, axes), "components")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0)).alias(x)
    parts = rows.groupBy(run_of().alias("run")).agg(F.count("*").alias("n"), F.count_if(F.col("rk") < least).alias("few"), *map(total, ("elog_1mu", "own", "centre"))).collect()
    before = offsets({r["run"]: r["elog_1mu"] for r in parts}, False)
    if len(before) > 1:
        rows = rows.withColumn("log_weight", F.col("log_weight") + F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), run_of()))
    noise = lambda x: of[-1][x] if -1 in of else 0.0
    every = lambda x: sum(r[x] or 0.0 for r in of.values())
    sums = {"n": sum(r["n"] for r in parts), "few": sum(r["few"] for r in parts), "s": sum(r["elog_1mu"] for r in parts), "own": sum(r["own"] for r in parts), "centres": sum(r["centre"] for r in parts)}
    sums |= {"r0": noise("rk"), "r1": every("rk") - noise("rk"), "entropy": every("ent"), "cobs": -0.5 * (every("obs") - noise("obs"))}
    return rows.drop("own", "centre"), sums


def empty_components(components: DataFrame, least: float = 1.5) -> DataFrame:
    return components.where(F.col("rk") < least)
