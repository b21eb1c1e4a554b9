"""The variational bound and its change by a delete, merge, birth or split move."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from mixfield.functions.special import beta_array, c_alpha, c_beta, c_obs, lgamma_array, plogp
from mixfield.operators.estep import NOISE, point_columns
from mixfield.operators.mstep import observed, running_sums
from mixfield.operators.spatial import XY
from mixfield.operators.storage import written


@dataclass(frozen=True)
class Scalars:
    """Posterior of the share of noise, Beta(a, b), and of the concentration, Gamma(gamma1, gamma2).

    A share ``pi1`` or a concentration ``alpha0`` that is given is fixed, and the posterior of that one is of no effect.
    """

    a: float
    b: float
    gamma1: float
    gamma2: float
    pi1: float | None = None
    alpha0: float | None = None

    @property
    def alpha(self) -> float:
        return self.gamma1 / self.gamma2 if self.alpha0 is None else self.alpha0


def scalars(of: Row, resp_sums: Row, prior: dict, pi1: float | None = None, alpha0: float | None = None) -> Scalars:
    """From ``r0`` and ``r1`` (sums of noise and other responsibilities) and the ``totals`` of components, or fixed values."""
    return Scalars(prior["a"] + resp_sums["r0"], prior["b"] + resp_sums["r1"], prior["gamma1"] + of["n"], prior["gamma2"] - of["s"], pi1, alpha0)


def resp_sums(resp: DataFrame, axes=XY) -> DataFrame:
    """One row: ``r0``, ``r1``, ``entropy`` (sum of r ln r) and ``cobs``."""
    noise = F.col("c") == NOISE
    zero = F.lit(0.0)
    return resp.agg(
        F.coalesce(F.sum(F.when(noise, F.col("r")).otherwise(0.0)), zero).alias("r0"),
        F.coalesce(F.sum(F.when(noise, 0.0).otherwise(F.col("r"))), zero).alias("r1"),
        F.coalesce(F.sum(plogp(F.col("r"))), zero).alias("entropy"),
        (-0.5 * F.coalesce(observed(resp, axes), zero)).alias("cobs"),
    )


def stats_sums(stats: DataFrame) -> DataFrame:
    """``resp_sums`` from the rows of a step's statistics, ``c, rk, ent, obs``."""
    noise, zero = F.col("c") == NOISE, F.lit(0.0)
    total = lambda x: F.coalesce(F.sum(x), zero)
    return stats.agg(total(F.when(noise, F.col("rk")).otherwise(0.0)).alias("r0"), total(F.when(noise, 0.0).otherwise(F.col("rk"))).alias("r1"), total("ent").alias("entropy"), (-0.5 * total(F.when(noise, 0.0).otherwise(F.col("obs")))).alias("cobs"))


def centre_bound(mu: list[Column], v: list[Column]) -> Column:
    return sum((c_obs(m, s) for m, s in zip(mu, v, strict=True)), F.lit(0.0))


def own_bound(axes=XY) -> Column:
    return centre_bound([F.col(f"mu{a}") for a in axes], [F.col(f"v{a}") for a in axes])


def prior_bound(prior: dict, axes=XY) -> Column:
    return centre_bound([F.lit(prior[f"mu0{a}"]) for a in axes], [F.lit(prior["sigma02"]) for _ in axes])


def point_bound(axes=XY) -> Column:
    """Of an observation at its own variance."""
    return centre_bound([F.col(a) for a in axes], [F.col(f"s2{a}") for a in axes])


def stick_bound(components: DataFrame, s: Scalars, prior: dict) -> DataFrame:
    """One row ``stick``: the bound's part of the shares of components and their concentration."""
    own = F.coalesce(F.sum(c_beta(F.col("eta1"), F.col("eta0"))), F.lit(0.0))
    mean = F.lit(s.alpha)
    if s.alpha0 is not None:
        return components.agg((F.count("*") * c_beta(F.lit(1.0), mean) - own).alias("stick"))
    top = c_alpha(F.lit(prior["gamma1"]), F.lit(prior["gamma2"]), mean) - c_alpha(F.lit(s.gamma1), F.lit(s.gamma2), mean)
    return components.agg((top - own).alias("stick"))


def noise_bound(r0: Column, r1: Column, s: Scalars, prior: dict) -> Column:
    """The bound's part of the share of noise, from the sums of noise and other responsibilities."""
    if s.pi1 is not None:
        return r0 * (math.log(s.pi1 / (1 - s.pi1)) + prior["logp0"]) + (r0 + r1) * math.log(1 - s.pi1)
    return r0 * prior["logp0"] + c_beta(F.lit(prior["a"]), F.lit(prior["b"])) - c_beta(F.lit(s.a), F.lit(s.b))


def bound(sums: DataFrame, components: DataFrame, s: Scalars, prior: dict, axes=XY) -> DataFrame:
    """One row ``e_noise, e_obs, e_sb, e_ent, elbo`` from the sums of a step and the components it led to."""
    own = components.agg(F.coalesce(F.sum(prior_bound(prior, axes) - own_bound(axes)), F.lit(0.0)).alias("centres"))
    one = sums.crossJoin(own).crossJoin(stick_bound(components, s, prior))  # three single rows
    parts = one.select(noise_bound(F.col("r0"), F.col("r1"), s, prior).alias("e_noise"), (F.col("centres") + F.col("cobs")).alias("e_obs"), F.col("stick").alias("e_sb"), (-F.col("entropy")).alias("e_ent"))
    return parts.withColumn("elbo", F.col("e_noise") + F.col("e_obs") + F.col("e_sb") + F.col("e_ent"))


def totals(components: DataFrame, prior: dict, least: float = 0.0, axes=XY) -> Row:
    """What the scalars and the bound need of components, in one job: ``n``, ``s`` (expected logs), ``own`` (sticks), ``centres``, and ``few``, how many have less than ``least``."""
    zero = F.lit(0.0)
    total = lambda x: F.coalesce(F.sum(x), zero)
    return components.agg(
        F.count("*").alias("n"), total(F.col("elog_1mu")).alias("s"), total(c_beta(F.col("eta1"), F.col("eta0"))).alias("own"),
        total(prior_bound(prior, axes) - own_bound(axes)).alias("centres"), F.count_if(F.col("rk") < least).alias("few"),
    ).first()


def noise_value(r0: float, r1: float, s: Scalars, prior: dict) -> float:
    """``noise_bound`` as a number."""
    beta = lambda a, b: math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    if s.pi1 is not None:
        return r0 * (math.log(s.pi1 / (1 - s.pi1)) + prior["logp0"]) + (r0 + r1) * math.log(1 - s.pi1)
    return r0 * prior["logp0"] + beta(prior["a"], prior["b"]) - beta(s.a, s.b)


def bound_value(sums: Row, of: Row, s: Scalars, prior: dict) -> float:
    """``bound`` from the row of sums of a step and the ``totals`` of the components it led to."""
    beta = lambda a, b: math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    alpha = lambda a, b: a * math.log(b) - math.lgamma(a) - b * s.alpha
    noise = noise_value(sums["r0"], sums["r1"], s, prior)
    top = alpha(prior["gamma1"], prior["gamma2"]) - alpha(s.gamma1, s.gamma2) if s.alpha0 is None else of["n"] * beta(1.0, s.alpha0)
    return noise + of["centres"] + sums["cobs"] + top - of["own"] - sums["entropy"]


def _moved(components: DataFrame, before: Scalars, after: Scalars) -> DataFrame:
    """``eta0`` from the counts ``rk`` of the components as they are, with the new concentration in place of the old one.

    What an ``eta0`` has beside the counts of later components is kept, so the concentration of the step that made it needn't be known.
    """
    return running_sums(components, "rk", "_after", True).withColumn("eta0", F.col("_base") + F.col("_after") + F.lit(after.alpha - before.alpha)).drop("_after")


def _with_base(components: DataFrame) -> DataFrame:
    return running_sums(components, "rk", "_after", True).withColumn("_base", F.col("eta0") - F.col("_after")).drop("_after")


def _value(df: DataFrame) -> float:
    """The only number of ``df``; not a number where it is undefined, so that such a move is never accepted."""
    found = df.first()[0]
    return float("nan") if found is None else float(found)


def new_centre(stats: Row | dict, prior: dict, axes=XY) -> dict:
    """``mu*``, ``v*`` and ``rk`` of a component with the given sums."""
    out = {"rk": float(stats["rk"] or 0.0)}
    for a in axes:
        out[f"v{a}"] = 1.0 / (float(stats[f"sx{a}"] or 0.0) + 1.0 / prior["sigma02"])
        out[f"mu{a}"] = (float(stats[f"xx{a}"] or 0.0) + prior[f"mu0{a}"] / prior["sigma02"]) * out[f"v{a}"]
    return out


def _sums(rows: DataFrame, weight: Column, axes=XY) -> list[Column]:
    return [F.sum(weight).alias("rk"), *(F.sum(weight * F.col(a) / F.col(f"s2{a}")).alias(f"xx{a}") for a in axes), *(F.sum(weight / F.col(f"s2{a}")).alias(f"sx{a}") for a in axes), F.sum(weight * point_bound(axes)).alias("co")]


def _centre_value(spark, centre: dict, axes=XY) -> float:
    return _value(spark.range(1).select(centre_bound([F.lit(centre[f"mu{a}"]) for a in axes], [F.lit(centre[f"v{a}"]) for a in axes])))


def _result(spark, noise: float, stick: float, entropy: float, obs: float) -> DataFrame:
    return spark.range(1).select(F.lit(noise).alias("noise"), F.lit(stick).alias("stick"), F.lit(entropy).alias("entropy"), F.lit(obs).alias("obs"), F.lit(noise + stick + entropy + obs).alias("gap"))


def _noise_change(spark, moved: float, s: Scalars, after: Scalars, prior: dict) -> float:
    """By ``moved`` more responsibility for noise."""
    if s.pi1 is not None:
        return moved * (math.log(s.pi1 / (1 - s.pi1)) + prior["logp0"])
    return _value(spark.range(1).select(F.lit(moved) * prior["logp0"] - c_beta(F.lit(after.a), F.lit(after.b)) + c_beta(F.lit(s.a), F.lit(s.b))))


def gap_delete(resp: DataFrame, components: DataFrame, s: Scalars, prior: dict, k: int, axes=XY, stick: float | None = None) -> DataFrame:
    """One row ``noise, stick, entropy, obs, gap``: the change of the bound when component ``k`` becomes noise.

    Only the rows of ``k``, and the noise rows of its points, are read. A model whose shares are no sticks gives their part as ``stick``.
    """
    spark = resp.sparkSession
    both = written(resp.where(F.col("c").isin(k, NOISE)).select(*point_columns(axes), "c", "r"), "pair")
    own = both.where((F.col("c") == k) & (F.col("r") > 0)).drop("c")
    noise = both.where(F.col("c") == NOISE).select("id", F.col("r").alias("r0"))
    sums = own.join(noise, "id").agg(*_sums(own, F.col("r"), axes), F.sum(-plogp(F.col("r") + F.col("r0")) + plogp(F.col("r0")) + plogp(F.col("r"))).alias("entropy")).first()
    row = components.where(F.col("c") == k).select("elog_1mu", own_bound(axes).alias("co"), prior_bound(prior, axes).alias("co0")).first()
    moved = float(sums["rk"] or 0.0)
    after = replace(s, a=s.a + moved, b=s.b - moved, gamma1=s.gamma1 - 1, gamma2=s.gamma2 + row["elog_1mu"])
    if stick is None:
        rest = written(_moved(_with_base(components).where(F.col("c") != k), s, after), "moved")
        stick = _value(stick_bound(rest, after, prior)) - _value(stick_bound(components, s, prior))
    return _result(spark, _noise_change(spark, moved, s, after, prior), stick, float(sums["entropy"] or 0.0), -float(sums["co"] or 0.0) - row["co0"] + row["co"])


#: Nodes of a Chebyshev interpolation, which is exact in double precision where a function has no singularity within FAR half widths of the middle.
NODES, FAR = 20, 4.0


def _classes(shift: np.ndarray) -> list[np.ndarray]:
    """The places of shifts in classes of one sign and one power of two."""
    kind = np.sign(shift) * (np.floor(np.log2(np.maximum(np.abs(shift), 2.0**-40))) + 64)
    return [np.flatnonzero(kind == one) for one in np.unique(kind[np.isfinite(kind)])]


def shifted_sums(eta1: np.ndarray, eta0: np.ndarray, shift: np.ndarray, after: bool) -> np.ndarray:
    """For each component k the sum of ``c_beta(eta1_j, eta0_j + shift_k)`` over all j after it, or before it; components are in order.

    Shifts of a class lie close together: a sum is a smooth function of the shift, and is interpolated between nodes at which all sums are made at once. Where ``eta0`` is so small
    that it isn't smooth, the terms are added one by one. So the work grows with the components and not with their square.
    """
    n = len(eta1)
    out = np.where(np.isfinite(shift), 0.0, np.nan)
    of = lgamma_array(eta1)
    middles = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
    weights = (-1.0) ** np.arange(NODES) * np.sin(np.pi * (np.arange(NODES) + 0.5) / NODES)
    for own in _classes(shift):
        low, high = shift[own].min(), shift[own].max()
        mid, half = (low + high) / 2, (high - low) / 2
        far = (eta0 + mid > FAR * half) & (eta0 + low > 0)
        at = np.flatnonzero(far)
        # of the components far enough, so many come before each of these
        upto = np.searchsorted(at, own, "right" if after else "left")
        nodes, share = (middles, weights) if half > 0 else (np.zeros(1), np.ones(1))
        off = (shift[own] - mid) / half if half > 0 else np.zeros(len(own))
        total, norm, met = np.zeros(len(own)), np.zeros(len(own)), np.zeros(len(own), bool)
        for t, w in zip(nodes, share, strict=True):
            sums = np.append(0.0, np.cumsum(beta_array(eta1[at], eta0[at] + (mid + half * t), of[at])))
            value = sums[-1] - sums[upto] if after else sums[upto]
            d = off - t
            hit = d == 0
            d[hit] = 1.0
            total += w / d * value
            norm += w / d
            out[own[hit]] += value[hit]
            met |= hit
        out[own[~met]] += total[~met] / norm[~met]
        for j in np.flatnonzero(~far):
            ks = own[own < j] if after else own[own > j]
            if len(ks):
                out[ks] += beta_array(np.full(len(ks), eta1[j]), eta0[j] + shift[ks], np.full(len(ks), of[j]))
    return out


def _rests(components: DataFrame, s: Scalars) -> tuple[DataFrame, int]:
    """``c, rest``: the sum of ``c_beta`` over all other components without component c, whose count is then no longer among those after the earlier ones; and the number of components."""
    rows = components.select("c", "eta1", "eta0", "rk", "elog_1mu").limit(MOST + 1).toArrow().sort_by("c")
    if rows.num_rows > MOST:
        raise ValueError(f"more than {MOST} components")
    c, eta1, eta0, rk, gone = (rows.column(i).to_numpy().astype(np.float64 if i else np.int64) for i in range(5))
    change = (s.gamma1 - 1) / (s.gamma2 + gone) - s.alpha if s.alpha0 is None else np.zeros(len(c))
    rest = shifted_sums(eta1, eta0, change - rk, False) + shifted_sums(eta1, eta0, change, True)
    return components.sparkSession.createDataFrame(pa.table({"c": pa.array(c), "rest": pa.array(rest)}), "c long, rest double"), len(c)


#: Components whose deletions are looked at together; some 40 bytes each at the driver.
MOST = 1 << 20


def deletion_sums(resp: DataFrame, axes=XY) -> DataFrame:
    """``c, moved, co, entropy`` of the responsibilities, which ``gaps_delete`` needs of the points; ``near.deletion_sums`` makes the same in tasks."""
    noise = resp.where(F.col("c") == NOISE).select("id", F.col("r").alias("r0"))
    own = resp.where((F.col("c") != NOISE) & (F.col("r") > 0)).join(noise, "id")
    sums = own.groupBy("c").agg(*_sums(own, F.col("r"), axes), F.sum(-plogp(F.col("r") + F.col("r0")) + plogp(F.col("r0")) + plogp(F.col("r"))).alias("entropy")).withColumnRenamed("rk", "moved")
    return sums.select("c", "moved", "co", "entropy")


def gaps_delete(resp: DataFrame | None, components: DataFrame, s: Scalars, prior: dict, axes=XY, sums: DataFrame | None = None) -> DataFrame:
    """``c, noise, stick, entropy, obs, gap``: ``gap_delete`` of every component, in one pass over the responsibilities, or from their ``sums`` (see ``deletion_sums``).

    The part of the shares needs all components for each one: they come to the driver, of which there may be MOST.
    """
    sums = deletion_sums(resp, axes) if sums is None else sums
    rest, n = _rests(components, s)
    before = stick_bound(components, s, prior)
    rows = components.join(sums, "c", "left").na.fill(0.0, ["moved", "co", "entropy"]).crossJoin(F.broadcast(before)).join(rest, "c")
    moved = F.col("moved")
    if s.pi1 is None:
        share = moved * prior["logp0"] - c_beta(F.lit(s.a) + moved, F.lit(s.b) - moved) + c_beta(F.lit(s.a), F.lit(s.b))
    else:
        share = moved * (math.log(s.pi1 / (1 - s.pi1)) + prior["logp0"])
    if s.alpha0 is None:
        g1, g2 = F.lit(s.gamma1 - 1), F.lit(s.gamma2) + F.col("elog_1mu")
        alpha = g1 / g2
        top = c_alpha(F.lit(prior["gamma1"]), F.lit(prior["gamma2"]), alpha) - c_alpha(g1, g2, alpha)
    else:
        top = (n - 1) * c_beta(F.lit(1.0), F.lit(s.alpha0))
    rows = rows.select("c", share.alias("noise"), (top - F.col("rest") - F.col("stick")).alias("stick"), "entropy", (-F.col("co") - prior_bound(prior, axes) + own_bound(axes)).alias("obs"))
    return rows.withColumn("gap", F.col("noise") + F.col("stick") + F.col("entropy") + F.col("obs"))


def gap_merge(resp: DataFrame, components: DataFrame, s: Scalars, prior: dict, k1: int, k2: int, axes=XY, stick: float | None = None) -> DataFrame:
    """The same when component ``k2`` is added to ``k1 < k2``."""
    spark = resp.sparkSession
    pair = written(resp.where(F.col("c").isin(k1, k2)).select(*point_columns(axes), "r"), "pair")
    both = pair.groupBy(*point_columns(axes)).agg(F.sum("r").alias("r"), F.sum(plogp(F.col("r"))).alias("apart"))
    sums = both.agg(*_sums(both, F.col("r"), axes), F.sum(F.col("apart") - plogp(F.col("r"))).alias("entropy")).first()
    centre = new_centre(sums, prior, axes)
    old = components.where(F.col("c").isin(k1, k2)).agg(F.sum(own_bound(axes)).alias("co"), F.max(prior_bound(prior, axes)).alias("co0"), F.max(F.when(F.col("c") == k2, F.col("elog_1mu"))).alias("gone"), F.max(F.when(F.col("c") == k2, F.col("rk"))).alias("rk")).first()
    after = replace(s, gamma1=s.gamma1 - 1, gamma2=s.gamma2 + old["gone"])
    if stick is None:
        joined = _with_base(components).where(F.col("c") != k2).withColumn("rk", F.col("rk") + F.when(F.col("c") == k1, F.lit(old["rk"])).otherwise(0.0)).withColumn("eta1", 1.0 + F.col("rk"))
        stick = _value(stick_bound(written(_moved(joined, s, after), "moved"), after, prior)) - _value(stick_bound(components, s, prior))
    return _result(spark, 0.0, stick, float(sums["entropy"] or 0.0), -old["co0"] - _centre_value(spark, centre, axes) + old["co"])


def gap_birth(candidates: DataFrame, components: DataFrame, s: Scalars, prior: dict, axes=XY, stick: float | None = None) -> DataFrame:
    """The same when ``candidates``, rows of noise, become a component in front of all others."""
    spark = candidates.sparkSession
    sums = candidates.agg(*_sums(candidates, F.col("r"), axes)).first()
    centre = new_centre(sums, prior, axes)
    moved = centre["rk"]
    logs = components.agg(F.count("*").alias("n"), F.coalesce(F.sum("elog_1mu"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("rk"), F.lit(0.0)).alias("rk")).first()
    after = replace(s, a=s.a - moved, b=s.b + moved, gamma1=prior["gamma1"] + logs["n"] + 1, gamma2=prior["gamma2"] - logs["s"])
    if stick is None:
        old = _moved(_with_base(components), s, after).select("eta1", "eta0")
        born = spark.range(1).select(F.lit(1.0 + moved).alias("eta1"), F.lit(after.alpha + logs["rk"]).alias("eta0"))
        stick = _value(stick_bound(written(old.union(born), "moved"), after, prior)) - _value(stick_bound(components, s, prior))
    co0 = _value(spark.range(1).select(prior_bound(prior, axes)))
    return _result(spark, _noise_change(spark, -moved, s, after, prior), stick, 0.0, float(sums["co"] or 0.0) + co0 - _centre_value(spark, centre, axes))


def gap_split(proposed: DataFrame, components: DataFrame, s: Scalars, prior: dict, k: int, axes=XY, stick: float | None = None) -> DataFrame:
    """The same when component ``k`` becomes ``k`` and ``k + 1`` with the responsibilities ``r1`` and ``r2`` of ``proposed``.

    ``proposed`` has the columns of points for all that ``k`` has a responsibility for; the two add up to the old one.
    """
    spark = proposed.sparkSession
    first, second = F.col("r1"), F.col("r2")
    one = proposed.agg(*_sums(proposed, first, axes), F.sum(plogp(first + second) - plogp(first) - plogp(second)).alias("entropy")).first()
    two = proposed.agg(*_sums(proposed, second, axes)).first()
    centres = new_centre(one, prior, axes), new_centre(two, prior, axes)
    row = components.where(F.col("c") == k).select("elog_1mu", own_bound(axes).alias("co"), prior_bound(prior, axes).alias("co0")).first()
    logs = components.agg(F.count("*").alias("n"), F.sum("elog_1mu").alias("s")).first()
    after = replace(s, gamma1=s.gamma1 + 1, gamma2=prior["gamma2"] - logs["s"] + row["elog_1mu"])
    if stick is None:
        based = _with_base(components).withColumn("c", F.when(F.col("c") > k, F.col("c") + 1).otherwise(F.col("c")))
        at = F.col("c") == k
        kept = based.withColumn("rk", F.when(at, F.lit(centres[0]["rk"])).otherwise(F.col("rk"))).select("c", "rk", "_base")
        made = based.where(at).select((F.col("c") + 1).alias("c"), F.lit(centres[1]["rk"]).alias("rk"), "_base")
        both = written(_moved(kept.unionByName(made).withColumn("eta1", 1.0 + F.col("rk")), s, after), "moved")
        stick = _value(stick_bound(both, after, prior)) - _value(stick_bound(components, s, prior))
    return _result(spark, 0.0, stick, float(one["entropy"] or 0.0), row["co0"] - sum(_centre_value(spark, x, axes) for x in centres) + row["co"])
