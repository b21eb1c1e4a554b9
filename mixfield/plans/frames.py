"""The model with frames: components compete in the frames in which they are active, by Gamma weights; its fit and moves."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixfield.functions.special import c_gamma, digamma_value, lgamma_array
from mixfield.operators import elbo as bounds
from mixfield.operators import mstep, near, temporal
from mixfield.operators.components import insert_front, renumber
from mixfield.operators.elbo import Scalars, new_centre
from mixfield.operators.estep import BELONGING, NOISE, noise_logit_value, with_number
from mixfield.operators.spatial import XY
from mixfield.operators.storage import few_at_a_time, kept, sorted_table, written
from mixfield.plans.fit import Config, step_stats
from mixfield.sources.views import priors


@dataclass
class FrameModel:
    """``components(c, mu*, v*, rk, alpha)``: alpha is the weight of a component in the frames in which it is active."""

    points: DataFrame
    components: DataFrame
    scalars: Scalars
    prior: dict
    config: Config = field(default_factory=Config)
    radius: float = 30.0
    axes: tuple[str, ...] = XY
    elbo: float = -math.inf
    #: Components with too few points after the last step.
    few: int = 0
    #: The points in buckets of whole frames, if no frame has too many.
    by_frame: DataFrame | None = None
    #: The same with a row for each frame, once a step has read them.
    rows: DataFrame | None = None
    history: list[dict] = field(default_factory=list)
    #: ``i, j, alpha`` of the transitions of the four states, and the log evidence of the average trace.
    transitions: DataFrame | None = None
    const: float = 0.0

    def weights(self) -> DataFrame:
        return self.components.select("c", "alpha")

    def responsibilities(self) -> DataFrame:
        points = with_number(self.points, "_logit", noise_logit_value(self.prior["logp0"], self.scalars))
        return temporal.frame_estep(points, self.components, None, F.col("_logit"), self.radius, self.axes, self.config.search_radius, keep=("_logit",)).drop("_logit")

    def sent(self) -> near.Frames | None:
        """The components for tasks, if the points are kept by frames and there aren't too many."""
        logit = noise_logit_value(self.prior["logp0"], self.scalars)
        return None if self.by_frame is None else near.sent_frames(self.components, logit, self.radius, self.axes, self.config.search_radius, PAIRS)

    def present(self, only: list[int] | None = None) -> DataFrame:
        """``responsibilities`` that aren't 0, and those of noise; of the components ``only`` if given (noise is -1). What isn't returned is 0 in double precision."""
        there = self.sent()
        if there is not None:
            return near.frame_responsibilities(self.by_frame, there, self.axes, only)
        resp = self.responsibilities().where((F.col("c") == NOISE) | (F.col("r") > 0))
        return resp if only is None else resp.where(F.col("c").isin(*only))

    def frame_sums(self, least: float = 1e-10) -> DataFrame:
        """``frame, acc_0, acc_n0, nt, xi_t, seen, entropy``: mass of noise and of components, number and weight of those active, and of responsibilities above ``least`` their number and the sum of r ln r."""
        there = self.sent()
        if there is not None:
            return near.frame_sums(self.by_frame, there, self.axes, least)
        logit = F.lit(noise_logit_value(self.prior["logp0"], self.scalars))
        sums = temporal.frame_sums(self.points, self.components.drop("alpha"), self.weights(), logit, self.radius, self.axes)
        tall = self.responsibilities().where((F.col("c") != NOISE) & (F.col("r") > least)).groupBy("frame").agg(F.count("*").alias("seen"), F.sum(F.col("r") * F.ln("r")).alias("entropy"))
        return sums.join(tall, "frame", "left").na.fill({"seen": 0, "entropy": 0.0})

    def share_bound(self) -> float:
        return float(temporal.frame_share_bound(self.weights(), self.prior["alpha0"]).first()["bound"])


def start(points: DataFrame, centres: DataFrame, config: Config | None = None, prior: dict | None = None, radius: float = 30.0, axes=XY) -> FrameModel:
    """A model of ``points(id, frame, ...)`` with the components ``centres(c, mu*, v*, eta1)``, whose ``eta1`` are the weights.

    The weights stay as they are in steps; moves change those of the components that they touch.
    """
    points = kept(points, "points")
    prior, config = prior or priors(points, axes), config or Config()
    rows = centres.select("c", *(f"mu{a}" for a in axes), *(f"v{a}" for a in axes), (F.col("eta1") - 1.0).alias("rk"), F.col("eta1").alias("alpha"))
    fixed = config.fixed(prior) | {"alpha0": prior["alpha0"]}
    most = points.groupBy("frame").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_frame = sorted_table(points.repartition(buckets, "frame"), "frames", buckets, "frame") if 0 < most <= FRAME_POINTS else None
    return FrameModel(points, written(rows, "components"), Scalars(prior["a"], prior["b"], 1.0, 1.0, **fixed), prior, config, radius, tuple(axes), by_frame=by_frame)


def bound(sums: DataFrame, model: FrameModel) -> DataFrame:
    """One row ``e_noise, e_obs, e_share, e_ent, elbo`` from the sums of a step and the components it led to."""
    own = model.components.agg(F.coalesce(F.sum(bounds.prior_bound(model.prior, model.axes) - bounds.own_bound(model.axes)), F.lit(0.0)).alias("centres"))
    share = temporal.frame_share_bound(model.weights(), model.prior["alpha0"])
    one = sums.crossJoin(own).crossJoin(share)  # three single rows
    parts = one.select(bounds.noise_bound(F.col("r0"), F.col("r1"), model.scalars, model.prior).alias("e_noise"), (F.col("centres") + F.col("cobs")).alias("e_obs"), F.col("bound").alias("e_share"), (-F.col("entropy")).alias("e_ent"))
    return parts.withColumn("elbo", F.col("e_noise") + F.col("e_obs") + F.col("e_share") + F.col("e_ent"))


def global_step(model: FrameModel, resp: DataFrame | None = None) -> tuple[FrameModel, DataFrame]:
    """The model with means, variances, counts and share of noise from ``resp``, or from a local step, and the sums for its bound; weights stay."""
    if resp is not None:
        stats = step_stats(resp, model.axes)
    else:
        model, there = _with_rows(model), model.sent()
        stats = step_stats(model.responsibilities(), model.axes) if there is None else near.frame_stats(model.rows, there, model.axes)
    with few_at_a_time(model.points.sparkSession, FRAMES):
        stats = written(stats, "stats")
    sums = bounds.stats_sums(stats)
    moved = mstep.moved(model.components, stats.drop("ent", "obs"), model.prior, model.axes)
    components = written(moved.join(model.weights(), "c"), "components")
    row = sums.first()
    scalars = replace(model.scalars, a=model.prior["a"] + row["r0"], b=model.prior["b"] + row["r1"])
    return replace(model, components=components, scalars=scalars), sums


def step(model: FrameModel, what: str = "update") -> FrameModel:
    """A local and a global step, and the bound: ``global_step`` and ``bound`` in one pass over the points, which leaves a row for each component.

    Where the points are kept by frames, a frame is one row: its active components, their weights and its part of all sums are made there, and no point is shuffled; the sums of a component come to the
    driver, which has sent it to the tasks. Else frames and points are joined.
    """
    axes, prior = model.axes, model.prior
    there = model.sent()
    if there is not None:
        return _step_in_arrays(model, there, what)
    if model.by_frame is None:
        resp = model.responsibilities()
        nothing = {c: F.lit(0.0 if c == "r" else 1.0) for c in resp.columns if c not in ("c", "id", "frame")}
        stats = step_stats(resp.select("c", *nothing), axes).withColumnRenamed("rk", "mass")
    else:
        stats = step_stats(model.responsibilities(), axes).withColumnRenamed("rk", "mass")
    sums = [c for c in stats.columns if c != "c"]
    # a row of zeros for each component: those without points stay
    every = stats.withColumn("alpha", F.lit(None).cast("double")).unionByName(model.components.select("c", *(F.lit(0.0).alias(x) for x in sums), "alpha"))
    rows = every.groupBy("c").agg(*(F.sum(x).alias(x) for x in sums), F.max("alpha").alias("alpha"))
    for a in axes:
        rows = rows.withColumn(f"v{a}", 1.0 / (F.col(f"sx{a}") + 1.0 / prior["sigma02"])).withColumn(f"mu{a}", (F.col(f"xx{a}") + prior[f"mu0{a}"] / prior["sigma02"]) * F.col(f"v{a}"))
    rows = written(rows.select("c", *(f"mu{a}" for a in axes), *(f"v{a}" for a in axes), F.col("mass").alias("rk"), "alpha", "ent", "obs"), "components")
    own = F.col("c") != NOISE
    total = lambda x: F.coalesce(F.sum(F.when(own, x)), F.lit(0.0))
    row = rows.agg(
        F.coalesce(F.sum(F.when(~own, F.col("rk"))), F.lit(0.0)).alias("r0"), total(F.col("rk")).alias("r1"), F.coalesce(F.sum("ent"), F.lit(0.0)).alias("entropy"), (-0.5 * total(F.col("obs"))).alias("cobs"),
        total(bounds.prior_bound(prior, axes) - bounds.own_bound(axes)).alias("centres"), total(c_gamma(F.lit(float(prior["alpha0"])), F.lit(1.0)) - c_gamma(F.col("alpha"), F.lit(1.0))).alias("share"),
        F.count_if(own).alias("n"), F.count_if(own & (F.col("rk") < model.config.least_count)).alias("few"),
    ).first()
    scalars = replace(model.scalars, a=prior["a"] + row["r0"], b=prior["b"] + row["r1"])
    elbo = bounds.noise_value(row["r0"], row["r1"], scalars, prior) + row["centres"] + row["cobs"] + row["share"] - row["entropy"]
    history = [*model.history, {"iteration": len(model.history), "elbo": elbo, "components": row["n"], "what": what}]
    return replace(model, components=rows.where(own).drop("ent", "obs"), scalars=scalars, elbo=elbo, few=row["few"], history=history)


#: Points are kept by frames where no frame has more of them.
FRAME_POINTS = 1 << 20
#: Points times components that are looked at together.
PAIRS = 1 << 20


#: Frames that a worker gets at a time.
FRAMES = 8


def _with_rows(model: FrameModel) -> FrameModel:
    return model if model.rows is not None or model.by_frame is None else replace(model, rows=written(near.frame_rows(model.by_frame, model.axes), "frame-rows"))


def _step_in_arrays(model: FrameModel, there: near.Frames, what: str) -> FrameModel:
    """``step`` with one job: the points leave a row for each component, of which the rest is made in arrays."""
    model = _with_rows(model)
    axes, prior, spark, c = model.axes, model.prior, model.points.sparkSession, there.everywhere.c.astype(np.int64)
    with few_at_a_time(spark, FRAMES):
        found = near.frame_stats(model.rows, there, axes).toArrow()
    names, ids = near.stat_names(axes)[1:], found.column("c").to_numpy()
    values, own = near.matrix(found, names), ids != NOISE
    order, sums = np.argsort(c), np.zeros((len(c), len(names)))
    sums[order[np.searchsorted(c[order], ids[own])]] = values[own]
    part, noise = dict(zip(names, sums.T, strict=True)), dict(zip(names, values[~own].sum(axis=0), strict=True))
    v = {a: 1.0 / (part[f"sx{a}"] + 1.0 / prior["sigma02"]) for a in axes}
    mu = {a: (part[f"xx{a}"] + prior[f"mu0{a}"] / prior["sigma02"]) * v[a] for a in axes}
    rows = pa.table({"c": c} | {f"mu{a}": mu[a] for a in axes} | {f"v{a}": v[a] for a in axes} | {"rk": part["rk"], "alpha": there.alpha.astype(np.float64)})
    components = spark.createDataFrame(rows, "c long, " + ", ".join(f"{n} double" for n in rows.column_names[1:]))
    obs = lambda m, s2: -0.5 * (m * m / s2 + np.log(2 * math.pi * s2))
    centres = sum(float((obs(prior[f"mu0{a}"], prior["sigma02"]) - obs(mu[a], v[a])).sum()) for a in axes)
    share = float((lgamma_array(there.alpha) - math.lgamma(prior["alpha0"])).sum())
    r0, r1 = float(noise["rk"]), float(part["rk"].sum())
    scalars = replace(model.scalars, a=prior["a"] + r0, b=prior["b"] + r1)
    entropy = float(part["ent"].sum() + noise["ent"])
    elbo = bounds.noise_value(r0, r1, scalars, prior) + centres - 0.5 * float(part["obs"].sum()) + share - entropy
    history = [*model.history, {"iteration": len(model.history), "elbo": elbo, "components": len(c), "what": what}]
    return replace(model, components=components, scalars=scalars, elbo=elbo, few=int((part["rk"] < model.config.least_count).sum()), history=history)


def fit(model: FrameModel) -> FrameModel:
    """Steps until the bound changes by less than the tolerance, relative to its size, or the iterations are used up, then the transitions; the best configuration is returned."""
    best, last = model, -math.inf
    for _ in range(model.config.iterations):
        model = step(model)
        if model.config.prune and model.few:
            few = [r["c"] for r in mstep.empty_components(model.components, model.config.least_count).select("c").collect()]
            model = step(replace(model, components=written(renumber(model.components, few), "components")), "empty")
        if model.elbo > best.elbo:
            best = model
        if abs(model.elbo - last) < model.config.tolerance * max(1.0, abs(model.elbo)):
            break
        last = model.elbo
    return with_transitions(replace(best, history=model.history))


def traces(model: FrameModel) -> DataFrame:
    """``c, frame``: the frames in which points belong to a component."""
    there = model.sent()
    if there is not None:
        return near.frame_traces(model.by_frame, there, model.axes, BELONGING)
    return model.present().where((F.col("c") != NOISE) & (F.col("r") > BELONGING)).select("c", "frame").distinct()


def with_transitions(model: FrameModel, steps: int = 10_000) -> FrameModel:
    """The model with the posterior of transitions: from first counts, then from all traces and the average decay."""
    spark = model.points.sparkSession
    seen = written(traces(model), "traces")
    prior = spark.createDataFrame(transition_prior(model), "i int, j int, prior double")
    posterior = lambda counts: written(prior.join(counts, ["i", "j"], "left").na.fill(0.0).select("i", "j", (F.col("prior") + F.col("n")).alias("alpha")), "transitions")
    counts, const = temporal.trace_counts(seen, posterior(temporal.first_counts(seen)), model.weights(), steps)
    return replace(model, transitions=posterior(counts), const=const)


def transition_prior(model: FrameModel) -> list[tuple[int, int, float]]:
    """The prior weights of the allowed transitions; waiting goes on with the weight of the concentration."""
    return [(i, j, float(model.prior["alpha0"]) if (i, j) == (0, 0) else w) for i, j, w in temporal.transition_prior()]


def transition_bound(model: FrameModel) -> float:
    """The part of the transitions in the bound, with the average trace of each component."""
    prior = transition_prior(model)
    spark = model.points.sparkSession
    counts = model.transitions.join(spark.createDataFrame(prior, "i int, j int, prior double"), ["i", "j"]).select("i", "j", (F.col("alpha") - F.col("prior")).alias("n"))
    return float(temporal.transition_bound(spark, counts, prior).first()["bound"]) + model.const * model.components.count()


# Moves: their gaps are the change of the bound, with the Gamma weights in place of sticks.


def _c(spark, alpha: float) -> float:
    return float(spark.range(1).select(c_gamma(F.lit(float(alpha)), F.lit(1.0))).first()[0])


def _sticks(model: FrameModel) -> DataFrame:
    """Components with the columns that the gaps of sticks read; their part is given instead."""
    return model.components.withColumns({"eta1": 1.0 + F.col("rk"), "eta0": F.lit(1.0), "elog_1mu": F.lit(0.0)})


def _alpha(model: FrameModel, *which: int) -> list[float]:
    found = {r["c"]: r["alpha"] for r in model.components.where(F.col("c").isin(*which)).select("c", "alpha").collect()}
    return [found[k] for k in which]


def gap_delete(model: FrameModel, resp: DataFrame, k: int) -> DataFrame:
    """One row ``noise, stick, entropy, obs, gap`` as of the model without frames."""
    spark = resp.sparkSession
    share = _c(spark, _alpha(model, k)[0]) - _c(spark, model.prior["alpha0"])
    return bounds.gap_delete(resp, _sticks(model), model.scalars, model.prior, k, model.axes, share)


def merged_weight(model: FrameModel, k1: int, k2: int) -> float:
    """The weights of both, less what the prior would have for one of them."""
    return sum(_alpha(model, k1, k2)) - model.prior["alpha0"] / model.components.count()


def gap_merge(model: FrameModel, resp: DataFrame, k1: int, k2: int) -> DataFrame:
    spark = resp.sparkSession
    share = sum(_c(spark, a) for a in _alpha(model, k1, k2)) - _c(spark, merged_weight(model, k1, k2)) - _c(spark, model.prior["alpha0"])
    return bounds.gap_merge(resp, _sticks(model), model.scalars, model.prior, k1, k2, model.axes, share)


def born_weight(mass: float) -> float:
    return 1.0 + mass


def gap_birth(model: FrameModel, candidates: DataFrame) -> DataFrame:
    spark = candidates.sparkSession
    mass = float(candidates.agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0])
    share = _c(spark, model.prior["alpha0"]) - _c(spark, born_weight(mass))
    return bounds.gap_birth(candidates, _sticks(model), model.scalars, model.prior, model.axes, share)


def split_weights(model: FrameModel, k: int, mass: tuple[float, float]) -> tuple[float, float]:
    """The weight of ``k`` and what a merge would take from it, by mass: so merging the halves gives the weight back."""
    whole = _alpha(model, k)[0] + model.prior["alpha0"] / (model.components.count() + 1)
    part = mass[0] / sum(mass) if sum(mass) > 0 else 0.5
    return whole * part, whole * (1 - part)


def gap_split(model: FrameModel, proposed: DataFrame, k: int) -> DataFrame:
    spark = proposed.sparkSession
    mass = proposed.agg(F.sum("r1").alias("a"), F.sum("r2").alias("b")).first()
    share = _c(spark, model.prior["alpha0"]) + _c(spark, _alpha(model, k)[0]) - sum(_c(spark, a) for a in split_weights(model, k, (mass["a"], mass["b"])))
    return bounds.gap_split(proposed, _sticks(model), model.scalars, model.prior, k, model.axes, share)


def _gap(row: DataFrame) -> float:
    return float(row.first()["gap"])


def _with_components(model: FrameModel, rows: DataFrame, what: str) -> FrameModel:
    return step(replace(model, components=written(rows.select(*model.components.columns), "components")), what)


def delete(model: FrameModel, k: int) -> FrameModel:
    """Makes component ``k`` noise if that raises the bound."""
    resp = written(model.present([k, NOISE]), "resp")
    return _with_components(model, renumber(model.components, [k]), "dead") if _gap(gap_delete(model, resp, k)) > 0 else model


def merge(model: FrameModel, k1: int, k2: int) -> FrameModel:
    """Adds component ``k2`` to ``k1 < k2`` if that raises the bound."""
    resp = written(model.present([k1, k2]), "resp")
    if _gap(gap_merge(model, resp, k1, k2)) <= 0:
        return model
    pair = resp.where(F.col("c").isin(k1, k2)).withColumn("c", F.lit(0))
    centre = new_centre(mstep.sufficient_stats(pair, model.axes).first(), model.prior, model.axes) | {"alpha": merged_weight(model, k1, k2)}
    at = F.col("c") == k1
    rows = model.components.withColumns({n: F.when(at, F.lit(v)).otherwise(F.col(n)) for n, v in centre.items()})
    return _with_components(model, renumber(rows, [k2]), "merge")


def birth(model: FrameModel, ids: DataFrame) -> FrameModel:
    """Makes a component of the noise of the points ``ids(id)`` if that raises the bound."""
    resp = model.present([NOISE]).where(F.col("c") == NOISE).join(ids.select("id").distinct(), "id", "left_semi")
    chosen = written(resp, "chosen")
    if chosen.isEmpty() or _gap(gap_birth(model, chosen)) <= 0:
        return model
    centre = new_centre(mstep.sufficient_stats(chosen.withColumn("c", F.lit(0)), model.axes).first(), model.prior, model.axes)
    row = model.points.sparkSession.createDataFrame([centre | {"c": 0, "alpha": born_weight(centre["rk"])}]).select(*model.components.columns)
    return _with_components(model, insert_front(model.components, row), "birth")


def split(model: FrameModel, k: int, proposed: DataFrame) -> FrameModel:
    """Makes ``k`` and ``k + 1`` of component ``k`` by ``r1`` and ``r2`` of ``proposed`` if that raises the bound."""
    if _gap(gap_split(model, proposed, k)) <= 0:
        return model
    halves = [new_centre(mstep.sufficient_stats(proposed.withColumn("c", F.lit(0)).withColumn("r", F.col(r)), model.axes).first(), model.prior, model.axes) for r in ("r1", "r2")]
    weights = split_weights(model, k, (halves[0]["rk"], halves[1]["rk"]))
    rest = model.components.where(F.col("c") != k).withColumn("c", F.when(F.col("c") > k, F.col("c") + 1).otherwise(F.col("c")).cast("long"))
    rows = [h | {"c": k + i, "alpha": w} for i, (h, w) in enumerate(zip(halves, weights, strict=True))]
    return _with_components(model, rest.unionByName(model.points.sparkSession.createDataFrame(rows).select(*model.components.columns)), "split")
