"""Variational fits: initial centres, update steps, pruning and moves, driven from here and computed as DataFrames."""

from __future__ import annotations

import math
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixfield.functions.special import plogp
from mixfield.operators import components as surgery
from mixfield.operators import elbo as bounds
from mixfield.operators import mstep, near, spatial
from mixfield.operators.components import insert_front, renumber
from mixfield.operators.elbo import Scalars, new_centre
from mixfield.operators.estep import BELONGING, NOISE, dense, every_pair, noise_logit, noise_logit_value, noise_points, point_columns, sparse, split_candidates
from mixfield.operators.order import numbered
from mixfield.operators.spatial import XY
from mixfield.operators.storage import discard, kept, written
from mixfield.sources.files import load_model, save_model
from mixfield.sources.views import cell_centres, priors, with_counts


@dataclass(frozen=True)
class Config:
    """What a fit does; distances are in the units of the points."""

    infer_pi1: bool = True
    infer_alpha0: bool = True
    #: None: every component is scored for every point; else only those within so many standard deviations.
    search_radius: float | None = None
    iterations: int = 100
    tolerance: float = 1e-10
    prune: bool = True
    least_count: float = 1.5
    redundant_radius: float = 1.0
    merge_sigmas: float = 4.0
    birth_radius: float = 15.0
    split_radius: float = 50.0
    propagate_rounds: int = 10
    seed: int = 7

    def fixed(self, prior: dict) -> dict:
        """The share of noise and the concentration where they are not inferred."""
        return {"pi1": None if self.infer_pi1 else prior["pi1"], "alpha0": None if self.infer_alpha0 else prior["alpha0"]}


@dataclass
class Model:
    points: DataFrame
    components: DataFrame
    scalars: Scalars
    prior: dict
    config: Config = field(default_factory=Config)
    axes: tuple[str, ...] = XY
    elbo: float = -math.inf
    #: Components with too few points after the last step.
    few: int = 0
    #: Rows for each step: iteration, elbo, number of components, what was done.
    history: list[dict] = field(default_factory=list)
    moves: dict[tuple[str, bool], int] = field(default_factory=dict)

    def logit(self):
        if self.config.infer_pi1:
            return noise_logit(self.prior["logp0"], self.scalars.a, self.scalars.b)
        return noise_logit(self.prior["logp0"], pi1=self.prior["pi1"])

    def responsibilities(self, points: DataFrame | None = None) -> DataFrame:
        points = self.points if points is None else points
        if self.config.search_radius is None:
            return dense(points, self.components, self.logit(), self.axes)
        return sparse(points, self.components, self.logit(), self.config.search_radius, self.axes)

    def every_pair(self, points: DataFrame | None = None) -> DataFrame:
        """``responsibilities`` without a search radius, for any number of components up to ``near.MAX_SENT``: a row for noise and each component of every point."""
        points, centres = self.points if points is None else points, self.centres()
        if centres is None or self.config.search_radius is not None:
            return self.responsibilities(points)
        return every_pair(written(near.with_totals(points, centres, self.axes), "totals"), self.components, centres.logit, self.axes)

    def centres(self) -> near.Centres | None:
        """The components for tasks, if there aren't too many."""
        return near.sent(self.components, noise_logit_value(self.prior["logp0"], self.scalars), self.axes, self.config.search_radius)

    def present(self, only: list[int] | None = None) -> DataFrame:
        """``responsibilities`` that aren't 0, and those of noise; of the components ``only`` if given (noise is -1). What isn't returned is 0 in double precision."""
        centres = self.centres()
        if centres is not None:
            return near.responsibilities(self.points, centres, self.axes, only)
        resp = self.responsibilities()
        return resp.where((F.col("c") == NOISE) | (F.col("r") > 0)) if only is None else resp.where(F.col("c").isin(*only) & ((F.col("c") == NOISE) | (F.col("r") > 0)))

    def history_table(self) -> DataFrame:
        return self.points.sparkSession.createDataFrame(self.history or [{"iteration": -1, "elbo": 0.0, "components": 0, "what": ""}], "iteration long, elbo double, components long, what string").where("iteration >= 0")

    def moves_table(self) -> DataFrame:
        kinds = [(k, self.moves.get((k, True), 0), self.moves.get((k, False), 0)) for k in ("birth", "dead", "merge", "split")]
        return self.points.sparkSession.createDataFrame(kinds, "move string, accepted int, rejected int")


def by_place(points: DataFrame, axes=XY) -> DataFrame:
    """The points as a table that is read at every step, dealt out along their longest axis: so a task meets the components of its stretch and not all of them."""
    spark = points.sparkSession
    reach = points.agg(*(F.coalesce(F.max(a) - F.min(a), F.lit(0.0)).alias(a) for a in axes)).first()
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    long = max(axes, key=lambda a: reach[a])
    return written(points.repartitionByRange(parts, long, "id").sortWithinPartitions(long), "points")


def start(points: DataFrame, centres: DataFrame, config: Config | None = None, prior: dict | None = None, axes=XY) -> Model:
    """A model with the components ``centres(c, mu*, v*, eta1, eta0)``."""
    points = kept(points, "points")
    prior = prior or priors(points, axes)
    components = mstep.stick_weights(centres.withColumn("rk", F.col("eta1") - 1.0)).select("c", *(f"mu{a}" for a in axes), *(f"v{a}" for a in axes), "rk", "eta1", "eta0", "elog_u", "elog_1mu", "log_weight")
    config = config or Config()
    return Model(by_place(points, axes), written(components, "components"), Scalars(prior["a"], prior["b"], prior["gamma1"], prior["gamma2"], **config.fixed(prior)), prior, config, tuple(axes))


def save(model: Model, path: str) -> None:
    """A snapshot from which ``restart`` goes on: components, scalars, priors, settings and history."""
    numbers = {k: v for k, v in asdict(model.scalars).items() if v is not None}
    numbers |= {f"prior_{k}": v for k, v in model.prior.items()} | {"elbo": model.elbo, "few": model.few, "config": json.dumps(asdict(model.config)), "axes": "".join(model.axes), "moves": json.dumps([[*k, n] for k, n in model.moves.items()])}
    save_model(model.components, numbers, path)
    model.history_table().write.mode("overwrite").parquet(f"{path}/history")


def restart(points: DataFrame, path: str) -> Model:
    """The model of a snapshot on its ``points``, as if it had never been stopped."""
    spark = points.sparkSession
    components, numbers = load_model(spark, path)
    prior = {k.removeprefix("prior_"): v for k, v in numbers.items() if k.startswith("prior_")}
    scalars = Scalars(*(numbers[k] for k in ("a", "b", "gamma1", "gamma2")), numbers.get("pi1"), numbers.get("alpha0"))
    history = [r.asDict() for r in spark.read.parquet(f"{path}/history").orderBy("iteration").collect()]
    moves = {(name, accepted): n for name, accepted, n in json.loads(numbers["moves"])}
    return Model(by_place(kept(points, "points"), numbers["axes"]), written(components, "components"), scalars, prior, Config(**json.loads(numbers["config"])), tuple(numbers["axes"]), numbers["elbo"], numbers["few"], history, moves)


def initial_centres(points: DataFrame, kind: str = "density_peaks", prior: dict | None = None, axes=XY, **options) -> DataFrame:
    """Centres ``c, mu*, v*, n, eta1, eta0`` by ``points``, ``cells``, ``density``, ``density_peaks``, ``nearest`` or ``post``.

    ``post`` takes those of the snapshot at ``path``. ``points`` makes every point a centre, so it needs the sparse step.
    """
    alpha0 = (prior or {}).get("alpha0", 10.0)
    if kind == "post":
        return load_model(points.sparkSession, options["path"])[0].select("c", *(f"mu{a}" for a in axes), *(f"v{a}" for a in axes), F.col("rk").alias("n"), "eta1", "eta0")
    if kind == "cells":
        return cell_centres(points, alpha0=alpha0, axes=axes, **options)
    mean = sum((F.avg(f"s2{a}") for a in axes), F.lit(0.0)) / len(axes)
    v = points.agg(mean.alias("v"))
    if kind == "points":
        found = points.select("id", *(F.col(a).alias(f"mu{a}") for a in axes), F.lit(1).alias("n"))
        v = points.sparkSession.range(1).select(F.lit(5.0).alias("v"))
    elif kind == "density_peaks":
        found = spatial.peaks(points, axes=axes, **options).select("id", *(F.col(a).alias(f"mu{a}") for a in axes), F.lit(1).alias("n"))
    elif kind in ("density", "nearest"):
        labels = spatial.density_labels(points, axes=axes, **options) if kind == "density" else spatial.nearest_labels(points, axes=axes, **options)
        found = spatial.label_means(points, labels, axes).withColumnRenamed("label", "id")
    else:
        raise ValueError(f"unknown initializer {kind}")
    rows = numbered(found, "c", "id").withColumn("c", F.col("c").cast("long")).drop("id").crossJoin(F.broadcast(v)).select("c", *(f"mu{a}" for a in axes), *(F.col("v").alias(f"v{a}") for a in axes), "n")
    return with_counts(rows, alpha0)


def step_stats(resp: DataFrame, axes) -> DataFrame:
    """Sufficient statistics with each component's part of entropy and of ``cobs``, so that a step reads the points once."""
    terms = sum((F.col(a) * F.col(a) / F.col(f"s2{a}") + F.ln(2 * math.pi * F.col(f"s2{a}")) for a in axes), F.lit(0.0))
    sums = [F.sum(F.col("r") * F.col(a) / F.col(f"s2{a}")).alias(f"xx{a}") for a in axes] + [F.sum(F.col("r") / F.col(f"s2{a}")).alias(f"sx{a}") for a in axes]
    return resp.groupBy("c").agg(F.sum("r").alias("rk"), *sums, F.sum(plogp(F.col("r"))).alias("ent"), F.sum(F.col("r") * terms).alias("obs"))


def local_stats(model: Model) -> DataFrame:
    """``step_stats`` of the local step."""
    centres = model.centres()
    return step_stats(model.responsibilities(), model.axes) if centres is None else near.stats(model.points, centres, model.axes)


def step(model: Model, what: str = "update", from_resp: DataFrame | None = None, stats: DataFrame | None = None) -> Model:
    """A local and a global step, or a global one from given responsibilities or statistics, and the bound."""
    own = stats is None
    if own:
        stats = written(local_stats(model) if from_resp is None else step_stats(from_resp, model.axes), "stats")
    components, sums = mstep.update(model.components, stats, model.prior, model.scalars.alpha, model.axes, model.config.least_count)
    scalars = bounds.scalars(sums, sums, model.prior, **model.config.fixed(model.prior))
    elbo = bounds.bound_value(sums, sums, scalars, model.prior)
    if own:
        discard(stats)
    history = [*model.history, {"iteration": len(model.history), "elbo": elbo, "components": sums["n"], "what": what}]
    return replace(model, components=components, scalars=scalars, elbo=elbo, few=sums["few"], history=history)


def drop_components(model: Model, gone: list[int]) -> Model:
    return replace(model, components=written(renumber(model.components, sorted(gone)), "components")) if gone else model


def prune(model: Model) -> Model:
    """Drops components with too few points and, of components closer than the redundant radius, those that a fuller one is close to."""
    if model.few:
        few = [r["c"] for r in mstep.empty_components(model.components, model.config.least_count).select("c").collect()]
        model = step(drop_components(model, few), "empty")
    counts = model.components.select("c", "rk")
    pairs = spatial.close_centres(model.components, model.config.redundant_radius, model.axes)
    rows = pairs.join(counts, "c").join(counts.select(F.col("c").alias("other"), F.col("rk").alias("rk_other")), "other")
    lesser = rows.where((F.col("rk") < F.col("rk_other")) | ((F.col("rk") == F.col("rk_other")) & (F.col("c") > F.col("other")))).select("c").distinct()
    gone = [r["c"] for r in lesser.collect()]
    return step(drop_components(model, gone), "redundant") if gone else model


def fit(model: Model) -> Model:
    """Steps until the bound changes by less than the tolerance, relative to its size, or the iterations are used up; the best configuration is returned."""
    best, last = model, -math.inf
    for _ in range(model.config.iterations):
        model = step(model)
        if model.config.prune:
            model = prune(model)
        if model.elbo > best.elbo:
            best = model
        if abs(model.elbo - last) < model.config.tolerance * max(1.0, abs(model.elbo)):
            break
        last = model.elbo
    return replace(best, history=model.history, moves=model.moves)


# Components taken out, put in, merged or split as told, whatever the bound says


def delete_components(model: Model, gone: list[int]) -> Model:
    """The model after a global step with the responsibilities of the components ``gone`` given to noise."""
    return step(drop_components(model, gone), "dead", surgery.remove(model.present(), gone, model.axes))


def add_component(model: Model, ids: DataFrame) -> Model:
    """The model after a global step with a new component 0 that has the noise of the points ``ids(id)``."""
    resp = surgery.insert_from_noise(model.responsibilities(), ids)
    return step(_with_front(model, {f"{n}{a}": 0.0 for n in ("mu", "v") for a in model.axes} | {"rk": 0.0}), "birth", resp)


def merge_components(model: Model, k1: int, k2: int) -> Model:
    """The model after a global step with the responsibilities of ``k2`` added to those of ``k1 < k2``."""
    return step(drop_components(model, [k2]), "merge", surgery.merge(model.present(), k1, k2, model.axes))


def split_component(model: Model, k: int, proposed: DataFrame) -> Model:
    """The model after a global step with ``k`` replaced by ``k`` and ``k + 1``, given by ``r1`` and ``r2`` of ``proposed``."""
    resp = surgery.split(model.responsibilities(), k, proposed, model.axes)
    moved = model.components.withColumn("c", F.when(F.col("c") > k, F.col("c") + 1).otherwise(F.col("c")).cast("long"))
    rows = moved.unionByName(moved.where(F.col("c") == k).withColumn("c", F.lit(k + 1).cast("long")))
    return step(replace(model, components=written(rows, "components")), "split", resp)


def _count(model: Model, move: str, accepted: bool) -> Model:
    return replace(model, moves=model.moves | {(move, accepted): model.moves.get((move, accepted), 0) + 1})


def _gap(row: DataFrame) -> float:
    return float(row.first()["gap"])


def birth_candidates(model: Model, noise: DataFrame):
    """Sets of noise points that may be a component: the densest neighbourhood, the largest of a few clusters, the largest dense group."""
    yield spatial.densest_neighbourhood(noise, model.config.birth_radius, model.axes)
    n = noise.count()
    centres = spatial.kmeans_seeds(noise, 2 if n < 10 else 5, model.config.seed, axes=model.axes)
    near = spatial.nearest_centre(noise, spatial.kmeans(noise, centres, 5, model.axes), model.axes).select("id", F.col("c").alias("label"))
    yield near.join(spatial.largest_label(near), "label", "left_semi").select("id")
    labels = written(spatial.density_labels(noise, radius=100.0, axes=model.axes), "labels")
    yield labels.join(spatial.largest_label(labels), "label", "left_semi").select("id")


def birth(model: Model, force: bool = False) -> Model:
    """Makes a component of noise points if that raises the bound (or always, with ``force``)."""
    noise = written(noise_points(model.present([NOISE])).select(*point_columns(model.axes), "r"), "noise")
    if noise.count() <= 5:
        return _count(model, "birth", False)
    for ids in birth_candidates(model, noise):
        chosen = written(noise.join(ids, "id", "left_semi"), "chosen")
        gap = _gap(bounds.gap_birth(chosen, model.components, model.scalars, model.prior, model.axes))
        if gap > 0 or force:
            sums = mstep.sufficient_stats(chosen.withColumn("c", F.lit(0)), model.axes).first()
            if sums is None:
                continue
            return _count(step(_with_front(model, new_centre(sums, model.prior, model.axes)), "birth"), "birth", True)
    return _count(model, "birth", False)


def _centre_rows(model: Model, centres: list[dict]) -> DataFrame:
    rows = [{"c": i, "eta1": 1.0 + x["rk"], "eta0": model.scalars.alpha, "elog_u": 0.0, "elog_1mu": 0.0, "log_weight": 0.0} | x for i, x in enumerate(centres)]
    return model.points.sparkSession.createDataFrame(rows).select(*model.components.columns)


def _with_front(model: Model, centre: dict) -> Model:
    alpha = model.scalars.alpha
    rows = insert_front(model.components, _centre_rows(model, [centre]))
    return replace(model, components=written(_restick(rows, alpha), "components"))


def _restick(rows: DataFrame, alpha: float) -> DataFrame:
    columns = rows.columns
    rows = mstep.running_sums(rows, "rk", "_after", True)
    return mstep.stick_weights(rows.withColumn("eta1", 1.0 + F.col("rk")).withColumn("eta0", F.lit(alpha) + F.col("_after")).drop("_after")).select(*columns)


def weighted_choice(rows: DataFrame, column: str, weight, key: str):
    """The value of ``column`` of one row, drawn in proportion to ``weight`` by hashes with ``key``; none without rows of a weight above 0.

    Each row has an exponential time at the rate of its weight, and the first one is drawn: one aggregation, without a row at the driver.
    """
    uniform = (F.pmod(F.xxhash64(F.lit(key), column), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    rows = rows.select(column, (-F.ln(uniform) / weight).alias("_time"), weight.alias("_weight")).where("_weight > 0")
    return rows.agg(F.min_by(column, F.struct("_time", column))).first()[0]


def _random_component(model: Model, salt: int, squared: bool = False) -> int | None:
    weight = F.coalesce("rk", F.lit(0.0)) * F.coalesce("rk", F.lit(0.0)) + 1e-12 if squared else F.lit(1.0)
    return weighted_choice(model.components, "c", weight, f"{model.config.seed} {salt} {len(model.history)}")


def delete(model: Model, k: int | None = None) -> Model:
    k = _random_component(model, 1) if k is None else k
    if k is None:
        return model
    resp = model.present([k, NOISE])
    if not resp.where((F.col("c") == k) & (F.col("r") > BELONGING)).limit(1).count():
        return _count(model, "dead", False)
    if _gap(bounds.gap_delete(resp, model.components, model.scalars, model.prior, k, model.axes)) <= 0:
        return _count(model, "dead", False)
    return _count(step(drop_components(model, [k]), "dead"), "dead", True)


def deletion_gaps(model: Model) -> DataFrame:
    """``bounds.gaps_delete`` of all components of the model."""
    centres = model.centres()
    resp, sums = (model.present(), None) if centres is None else (None, near.deletion_sums(model.points, centres, model.axes))
    return bounds.gaps_delete(resp, model.components, model.scalars, model.prior, model.axes, sums)


def apart(gaps: DataFrame, components: DataFrame, radius: float, axes=XY) -> DataFrame:
    """``c, gap`` of the rows of ``gaps(c, gap)`` that are the best among all of them within ``radius``, ties to the smaller c: moves of these touch different components."""
    rows = gaps.select("c", "gap")
    near = spatial.close_centres(components.join(rows, "c", "left_semi"), radius, axes).select("c", "other")
    better = near.join(rows, "c").join(rows.select(F.col("c").alias("other"), F.col("gap").alias("rival")), "other").where((F.col("rival") > F.col("gap")) | ((F.col("rival") == F.col("gap")) & (F.col("other") < F.col("c"))))
    return rows.join(better.select("c").distinct(), "c", "left_anti")


def delete_all(model: Model, rounds: int = 10) -> Model:
    """Makes all components noise whose deletion raises the bound, in rounds of one pass each.

    A round has the gaps of all components, and deletes those that are the best for as far as two birth radii around, so that they hardly share points. If the bound is lower after a step with
    all of them gone, only the best one goes. The number of jobs depends on the rounds and not on the number of components.
    """
    for _ in range(rounds):
        gaps = deletion_gaps(model)
        gaps = written(gaps.where(F.col("gap") > 0), "gaps")
        chosen = [r["c"] for r in apart(gaps, model.components, 2 * model.config.birth_radius, model.axes).orderBy(F.desc("gap"), "c").collect()]
        if not chosen:
            return _count(model, "dead", False)
        after = step(drop_components(model, chosen), "dead")
        if after.elbo < model.elbo and len(chosen) > 1:
            chosen = chosen[:1]
            after = step(drop_components(model, chosen), "dead")
        if after.elbo < model.elbo:
            return _count(model, "dead", False)
        for _ in chosen:
            after = _count(after, "dead", True)
        model = after
    return model


def merge(model: Model, k: int | None = None) -> Model:
    """Tries to merge component ``k`` with each one that is near, the last first."""
    k = _random_component(model, 2) if k is None else k
    if k is None:
        return model
    radius = model.config.merge_sigmas * model.prior["mean_sigma"]
    near = spatial.close_centres(model.components, radius, model.axes).where(F.col("c") == k)
    others = sorted((r["other"] for r in near.select("other").collect()), reverse=True)
    for other in others:
        k1, k2 = sorted((k, other))
        if _gap(bounds.gap_merge(model.present([k1, k2]), model.components, model.scalars, model.prior, k1, k2, model.axes)) <= 0:
            model = _count(model, "merge", False)
            continue
        gone = model.components.where(F.col("c") == k2).select(*model.components.columns).first()
        weight = F.when(F.col("c") == k1, F.lit(gone["rk"])).otherwise(0.0)
        joined = model.components
        for a in model.axes:
            mean = (F.col(f"mu{a}") * F.col("rk") + gone[f"mu{a}"] * weight) / F.greatest(F.col("rk") + weight, F.lit(1e-300))
            joined = joined.withColumn(f"mu{a}", F.when(F.col("c") == k1, mean).otherwise(F.col(f"mu{a}")))
        joined = joined.withColumn("rk", F.col("rk") + weight)
        joined = _restick(renumber(joined, [k2]), model.scalars.alpha)
        model = _count(step(replace(model, components=written(joined, "components")), "merge"), "merge", True)
        k = k1
    return model


def propagate(model: Model, candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """``r1, r2`` for ``candidates`` (points with the parent's ``r``): a few steps with two centres and no shares, then shared out."""
    centres = seeds.select("c", *(f"mu{a}" for a in model.axes), *(F.lit(0.0).alias(f"v{a}") for a in model.axes), F.lit(0.0).alias("log_weight"))
    logit = F.lit(-100.0)
    for _ in range(model.config.propagate_rounds):
        resp = dense(candidates, centres, logit, model.axes)
        stats = mstep.sufficient_stats(resp, model.axes)
        centres = written(mstep.moved(centres, stats, model.prior, model.axes).withColumn("log_weight", F.lit(0.0)).select(*centres.columns), "halves")
    both = dense(candidates, centres, logit, model.axes).where(F.col("c") >= 0).groupBy("id").agg(F.sum(F.when(F.col("c") == 0, F.col("r"))).alias("a"), F.sum("r").alias("t"))
    share = F.when(F.col("t") > 0, F.col("a") / F.col("t")).otherwise(0.5)
    rows = candidates.join(both, "id").withColumn("r1", F.col("r") * share)
    return rows.withColumn("r2", F.col("r") - F.col("r1")).drop("a", "t")


def split_seeds(model: Model, belonging: DataFrame):
    """Pairs of seed centres: two means, then opposite points of a circle at eight angles."""
    spark, axes = model.points.sparkSession, model.axes
    row = belonging.agg(*(F.avg(a).alias(f"m_{a}") for a in axes), *(F.coalesce(F.stddev_pop(a), F.lit(0.0)).alias(f"s_{a}") for a in axes)).first()
    if row[f"m_{axes[0]}"] is None:
        return
    make = lambda shifts: spark.createDataFrame([{"c": i} | {f"mu{a}": float(row[f"m_{a}"] + sign * d) for a, d in zip(axes, shifts, strict=True)} for i, sign in enumerate((-1, 1))])
    wide = max(axes, key=lambda a: row[f"s_{a}"])
    yield spatial.kmeans(belonging, make([row[f"s_{a}"] if a == wide else 0.0 for a in axes]), 5, axes).select("c", *(f"mu{a}" for a in axes))
    away = belonging.agg(*(F.max(F.abs(F.col(a) - row[f"m_{a}"])).alias(a) for a in axes)).first()
    reach = max(away[a] for a in axes) / 2
    for k in range(8):
        angle = math.pi * k / 8
        yield make([reach * math.cos(angle), reach * math.sin(angle), *[0.0] * (len(axes) - 2)])


def split(model: Model, k: int | None = None, seeds: int = 9) -> Model:
    """Splits component ``k`` where the best of the first ``seeds`` proposals raises the bound."""
    k = _random_component(model, 3, squared=True) if k is None else k
    if k is None:
        return model
    resp = written(model.present([k, NOISE]), "resp")
    if split_candidates(resp, model.components, k, model.config.split_radius, model.axes).limit(6).count() <= 5:
        return _count(model, "split", False)
    # all points with a responsibility, so that no mass is lost; those that belong to k make the seeds
    parent = written(resp.where((F.col("c") == k) & (F.col("r") > 0)).select(*point_columns(model.axes), "r"), "parent")
    best = None
    for i, pair in enumerate(split_seeds(model, parent.where(F.col("r") > BELONGING))):
        if i >= seeds:
            break
        proposed = written(propagate(model, parent, pair), "proposed")
        gap = _gap(bounds.gap_split(proposed, model.components, model.scalars, model.prior, k, model.axes))
        if gap > 0 and (best is None or gap > best[0]):
            best = gap, proposed
    if best is None:
        return _count(model, "split", False)
    halves = [new_centre(mstep.sufficient_stats(best[1].withColumn("c", F.lit(0)).withColumn("r", F.col(r)), model.axes).first(), model.prior, model.axes) for r in ("r1", "r2")]
    rest = model.components.where(F.col("c") != k).withColumn("c", F.when(F.col("c") > k, F.col("c") + 1).otherwise(F.col("c")).cast("long"))
    rows = rest.unionByName(_centre_rows(model, halves).withColumn("c", (F.col("c") + k).cast("long")))
    return _count(step(replace(model, components=written(_restick(rows, model.scalars.alpha), "components")), "split"), "split", True)


#: Iterations modulo 10 at which a move is tried.
SCHEDULE = {5: ("birth", "split"), 7: ("dead",), 2: ("merge",)}
MOVES = {"birth": birth, "dead": delete, "merge": merge, "split": split}


def fit_moves(model: Model, iterations: int) -> Model:
    """Steps while they change the bound or the number of components, with moves by ``SCHEDULE``; the best configuration is returned."""
    best, last, count = model, -math.inf, -1
    for i in range(iterations):
        n = model.components.count()
        if abs(model.elbo - last) > 1e-5 or n != count:
            last, count = model.elbo, n
            model = prune(step(model))
        for move in SCHEDULE.get(i % 10, ()):
            model = MOVES[move](model)
        if model.elbo > best.elbo:
            best = model
    return replace(best, history=model.history, moves=model.moves)


def sweep(model: Model, rounds: int | None = None) -> Model:
    rounds = model.components.count() // 2 if rounds is None else rounds
    for _ in range(rounds):
        for move in (birth, split, merge, delete):
            model = move(model)
        model = step(prune(model))
    return model


def refine(model: Model) -> Model:
    """A few births, then a split and a merge for each component, and deletions of all in rounds."""
    for _ in range(model.components.count() // 10):
        model = birth(model)
    for move in (split, merge):
        for k in range(model.components.count() - 1, -1, -1):
            if k < model.components.count():
                model = move(model, k)
    return prune(delete_all(model))
