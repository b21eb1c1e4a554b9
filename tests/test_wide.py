"""What has no bound on a group: percentiles, chains, nearest centres, seeds and choices; steps by frames, and restarts."""

import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixfield.operators import elbo, estep, metrics, near, order, spatial, temporal
from mixfield.plans import fit, frames
from mixfield.sources import files, generators, views
from mixfield.streaming.assign import assign


def test_percentiles_of_one_large_group_and_of_equal_values(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1)) for _ in range(501)] + [("b", 7.0)] * 400 + [("b", 1.0), ("b", 9.0)] + [("c", 2.5), ("d", None), (None, 1.0), (None, 4.0)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r.g: r for r in metrics.percentiles(frame, "g", "v", {"median": 0.5, "low": 0.025, "high": 0.975}).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(found) == set(groups)
    for g, own in groups.items():
        assert found[g].n == len(own) and abs(found[g]["mean"] - np.mean(own)) < 1e-9
        assert np.allclose([found[g].median, found[g].low, found[g].high], np.percentile(own, [50, 2.5, 97.5]))
    assert metrics.trace_summary(frame.limit(0), "g", "v").count() == 0


def test_accumulated_sums(spark):
    rows = [(i % 7, i, i * i % 5) for i in range(300)]
    found = order.accumulated(spark.createDataFrame(rows, "g long, x long, k long").repartition(6), "k", "before", "g", "x").collect()
    total = 0
    for r in sorted(found, key=lambda r: (r.g, r.x)):
        assert r.before == total
        total += r.k


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_long_chains_are_smoothed_in_blocks(spark, block):
    rng = np.random.default_rng(block)
    start, moves = np.array([0.7, 0.2, 0.1]), np.array([[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.0, 0.0, 1.0]])
    rows = [(s, 10 * t, rng.normal(0, 4, 3).tolist()) for s, n in ((1, 40), (2, 1), (5, 22)) for t in range(n)]
    found = temporal.smooth(spark.createDataFrame(rows, "seq long, t int, logp array<double>").repartition(4), start.tolist(), moves.tolist(), block).collect()
    assert Counter((r.seq, r.t) for r in found) == Counter((s, t) for s, t, _ in rows)
    for s in (1, 2, 5):
        p, _, evidence = temporal.forward_backward(np.array([e for q, _, e in rows if q == s]), start, moves)
        own = sorted((r.t, r.p, r.log_evidence) for r in found if r.seq == s)
        assert np.allclose([x for _, x, _ in own], p) and abs(own[0][2] - evidence) < 1e-8


def test_a_chain_far_longer_than_a_block(spark):
    rows = spark.range(60_000).select(F.lit(1).cast("long").alias("seq"), F.col("id").alias("t"), F.array(F.sin(F.col("id") / 50) * 2, F.lit(0.0)).alias("logp"))
    moves = np.array([[0.99, 0.01], [0.02, 0.98]])
    found = temporal.smooth(rows, [0.5, 0.5], moves.tolist(), 5000).orderBy("t").toPandas()
    p, _, evidence = temporal.forward_backward(np.stack([np.sin(np.arange(60_000) / 50) * 2, np.zeros(60_000)], axis=1), np.array([0.5, 0.5]), moves)
    assert np.allclose(np.stack(found["p"]), p, atol=1e-9) and abs(found["log_evidence"][0] - evidence) < 1e-6 * abs(evidence)


def test_nearest_centre_in_rings(spark):
    rng = random.Random(8)
    points = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(300)] + [(900, 1e6, -1e6), (901, float("nan"), 0.0), (902, None, 1.0), (903, float("inf"), 1.0)]
    points = spark.createDataFrame(points, "id long, x double, y double")
    centres = spark.createDataFrame([(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(80)] + [(100, 5.0, 5.0), (99, 5.0, 5.0)], "c long, mux double, muy double")
    want = {(r.id, r.c) for r in spatial.nearest_centre(points.where("id <= 900"), centres).collect()}
    assert {(r.id, r.c) for r in spatial.nearest_centre_rings(points, centres).collect()} == want
    assert {(r.id, r.c) for r in spatial.nearest_centre_rings(points, centres, first=0.01).collect()} == want
    assert spatial.nearest_centre_rings(points, centres.limit(0)).count() == 0
    one = spatial.nearest_centre_rings(points, centres.where("c = 99")).collect()
    assert len(one) == 301 and {r.c for r in one} == {99}


def test_nearest_truth_beyond_what_is_sent_to_all_tasks(spark, monkeypatch):
    rng = random.Random(2)
    sides = [[(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(n)] for n in (60, 50)]
    found, truth = (spark.createDataFrame(s, f"{name} long, mux double, muy double") for s, name in zip(sides, ("c", "truth"), strict=True))
    want = {(r.c, r.truth, round(r.d, 9)) for r in metrics.nearest_truth(found, truth).collect()}
    monkeypatch.setattr(metrics, "MAX_PACKED", 10)
    assert {(r.c, r.truth, round(r.d, 9)) for r in metrics.nearest_truth(found, truth).collect()} == want


def test_seeds_are_spread_out(spark):
    """Four far groups, one of which has nearly all points: seeds by distance find all of them, and cost about what brute force with the best of many draws costs."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (600, 2)), *(rng.normal(at, 1, (10, 2)) for at in ((80, 0), (0, 80), (80, 80)))])
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, x double, y double").repartition(4)
    seeds = spatial.kmeans_seeds(points, 4)
    at = np.array([[r.mux, r.muy] for r in seeds.orderBy("c").collect()])
    assert {(round(a / 80), round(b / 80)) for a, b in at} == {(0, 0), (1, 0), (0, 1), (1, 1)}
    cost = lambda c: ((x[:, None] - c) ** 2).sum(2).min(1).sum()
    best = min(cost(x[np.random.default_rng(k).choice(len(x), 4, replace=False)]) for k in range(50))
    assert cost(at) < best
    assert sorted(map(tuple, seeds.collect())) == sorted(map(tuple, spatial.kmeans_seeds(points.repartition(7), 4).collect()))
    same = points.select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    assert [tuple(r) for r in spatial.kmeans_seeds(same, 3).collect()] == [(0, 1.0, 2.0)] and spatial.kmeans_seeds(points.limit(0), 3).count() == 0


def test_choices_follow_their_weights(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 0.0), (3, 6.0)], "c long, w double")
    drawn = Counter(fit.weighted_choice(rows, "c", F.col("w"), f"draw {k}") for k in range(250))
    assert set(drawn) <= {0, 1, 3} and all(abs(drawn[c] / 250 - w / 10) < 0.1 for c, w in ((0, 1), (1, 3), (3, 6)))
    assert fit.weighted_choice(rows, "c", F.col("w"), "x") == fit.weighted_choice(rows.repartition(4), "c", F.col("w"), "x")
    assert fit.weighted_choice(rows.limit(0), "c", F.col("w"), "x") is None


def test_a_restart_goes_on_as_if_never_stopped(spark, tmp_path):
    points = generators.gaussian_grid(spark, 2, 20, pitch=60.0, s2=30.0, seed=3)
    model = fit.start(points, views.cell_centres(points, pitch=40.0), fit.Config(prune=False, seed=11))
    for _ in range(2):
        model = fit.step(model)
    fit.save(model, str(tmp_path / "m"))
    again = fit.restart(points, str(tmp_path / "m"))
    assert again.config == model.config and again.history == model.history and again.prior == model.prior
    for _ in range(2):
        model, again = fit.step(model), fit.step(again)
    assert len(again.history) == 4 and abs(again.elbo - model.elbo) < 1e-9 * abs(model.elbo)
    both = [np.array(m.components.orderBy("c").toPandas()) for m in (model, again)]
    assert np.allclose(*both)
    centres = fit.initial_centres(points, "post", path=str(tmp_path / "m"))
    assert math.isfinite(fit.step(fit.start(points, centres)).elbo)


def framed(spark, **config):
    points = generators.gaussian_grid(spark, 2, 25, pitch=60.0, s2=30.0, seed=3).withColumn("frame", (F.col("id") % 6).cast("int"))
    return frames.start(points, views.cell_centres(points, pitch=30.0), fit.Config(prune=False, **config))


@pytest.mark.parametrize("config", [{}, {"infer_pi1": False}, {"search_radius": 3.0}])
def test_frames_as_groups_and_frames_that_are_joined(spark, config, monkeypatch):
    """The steps of whole frames, cut into small parts, are those of the joined tables and of ``global_step`` with ``bound``."""
    model = framed(spark, **config)
    assert model.by_frame is not None
    joined = replace(model, by_frame=None)
    monkeypatch.setattr(frames, "PAIRS", 40)
    after, sums = frames.global_step(joined, joined.responsibilities())
    want = float(frames.bound(sums, after).first()["elbo"])
    for m in (frames.step(model), frames.step(joined)):
        assert abs(m.elbo - want) < 1e-9 * abs(want)
        both = [np.array(x.components.select(sorted(after.components.columns)).orderBy("c").toPandas(), float) for x in (m, after)]
        assert np.allclose(*both)
    monkeypatch.setattr(frames, "FRAME_POINTS", 3)
    assert framed(spark).by_frame is None


def test_frame_sums_without_pairs(spark):
    model = framed(spark)
    resp, weights = model.responsibilities(), model.weights()
    want = {r.frame: r for r in temporal.frame_accumulators(resp, weights).collect()}
    found = temporal.frame_sums(model.points, model.components, weights, F.lit(-9.0))
    again = {r.frame: r for r in temporal.frame_accumulators(temporal.frame_estep(model.points, model.components, weights, F.lit(-9.0)), weights).collect()}
    assert len(want) == 6
    for r in found.collect():
        assert np.allclose([r.acc_0, r.acc_n0, r.nt, r.xi_t], [again[r.frame][k] for k in ("acc_0", "acc_n0", "nt", "xi_t")])
    tables = temporal.frame_tables(model.points, model.components)
    rk2 = {r.c: r.rk2 for r in temporal.centre_weights(tables).collect()}
    assert rk2 == pytest.approx({r.c: r.rk2 for r in temporal.centre_frame_weight(resp, temporal.frame_accumulators(resp, weights)).collect()})


def test_assignment_with_many_components_and_by_cells(spark):
    rng = random.Random(1)
    centres = spark.createDataFrame([(i, rng.uniform(0, 1000), rng.uniform(0, 1000), 1.0, 1.0, -7.0) for i in range(2000)], "c long, mux double, muy double, vx double, vy double, log_weight double")
    points = spark.createDataFrame([(i, rng.uniform(0, 1000), rng.uniform(0, 1000), 4.0, 4.0) for i in range(300)], "id long, x double, y double, s2x double, s2y double")
    every = {r.id: (r.c, r.r) for r in assign(points, centres, F.lit(-14.0)).collect()}
    near = {r.id: (r.c, r.r) for r in assign(points, centres, F.lit(-14.0), radius=40.0).collect()}
    assert len(every) == 300 and all(every[i][0] == near[i][0] and abs(every[i][1] - near[i][1]) < 1e-9 for i in every)


@pytest.mark.parametrize("config", [{}, {"infer_pi1": False, "infer_alpha0": False}])
def test_gaps_of_all_deletions_are_those_of_each(spark, config):
    points = generators.gaussian_grid(spark, 2, 20, pitch=60.0, s2=30.0, seed=3)
    model = fit.step(fit.start(points, views.cell_centres(points, pitch=40.0), fit.Config(prune=False, **config)))
    resp = model.responsibilities()
    found = {r.c: r for r in elbo.gaps_delete(resp, model.components, model.scalars, model.prior).collect()}
    assert len(found) == model.components.count()
    for k in list(found)[:3]:
        want = elbo.gap_delete(resp, model.components, model.scalars, model.prior, k).first()
        assert np.allclose([found[k][n] for n in ("noise", "stick", "entropy", "obs", "gap")], [want[n] for n in ("noise", "stick", "entropy", "obs", "gap")], atol=1e-6)


def test_a_step_by_frames_in_arrays_is_that_of_joins_also_without_a_frame(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 1, 2, 5, None]), rng.uniform(0, 300), rng.uniform(0, 200), 4.0, 6.0) for i in range(400)]
    points = spark.createDataFrame(rows, "id long, frame int, x double, y double, s2x double, s2y double").repartition(3)
    model = frames.start(points, views.cell_centres(points), fit.Config(prune=False))
    arrays, joined = frames.step(model), frames.step(replace(model, by_frame=None))
    want = {r.c: list(r)[1:] for r in joined.components.select("c", "mux", "muy", "vx", "vy", "rk", "alpha").collect()}
    found = {r.c: list(r)[1:] for r in arrays.components.select("c", "mux", "muy", "vx", "vy", "rk", "alpha").collect()}
    assert set(found) == set(want) and all(np.allclose(found[c], want[c]) for c in want)
    assert abs(arrays.elbo - joined.elbo) < 1e-6 * abs(joined.elbo) and arrays.few == joined.few and np.isclose(arrays.scalars.a, joined.scalars.a)
    # a task leaves a row for each component, not for each frame
    assert near.frame_rows(model.by_frame).count() == 5 and arrays.rows is frames.step(arrays).rows


@pytest.mark.parametrize("kind", ["even", "heavy", "tail"])
def test_sums_for_shifts_are_those_of_all_pairs(kind):
    rng = np.random.default_rng(4)
    rk, change = rng.gamma(0.3, 300, 150), rng.uniform(-0.3, 0.2, 150)
    if kind == "heavy":
        rk[::31] *= 1000
    if kind == "tail":
        rk[75:], rk[0], rk[-1], change = 1e-9, 1e6, 5e4, np.zeros(150)
    eta1, eta0 = 1 + rk, 9.7 + np.append(np.cumsum(rk[::-1])[::-1][1:], 0)
    beta = lambda j, d: math.lgamma(eta1[j] + eta0[j] + d) - math.lgamma(eta1[j]) - math.lgamma(eta0[j] + d)
    before = [math.fsum(beta(j, change[k] - rk[k]) for j in range(k)) for k in range(150)]
    after = [math.fsum(beta(j, change[k]) for j in range(k + 1, 150)) for k in range(150)]
    assert np.allclose(elbo.shifted_sums(eta1, eta0, change - rk, False), before, rtol=1e-11, atol=1e-6)
    assert np.allclose(elbo.shifted_sums(eta1, eta0, change, True), after, rtol=1e-11, atol=1e-6)


def test_gaps_of_more_deletions_than_fit_into_a_row(spark):
    n = 20_500
    rows = spark.range(n).select(F.col("id").alias("c"), *(F.lit(1.0).alias(x) for x in ("mux", "muy", "vx", "vy")), F.lit(2.0).alias("rk"))
    model = fit.Model(None, fit._restick(rows.withColumns({x: F.lit(0.0) for x in ("eta1", "eta0", "elog_u", "elog_1mu", "log_weight")}), 3.0), elbo.Scalars(5.0, 6.0, 1.0 + n, 4.0), {"a": 1.0, "b": 10.0, "gamma1": 1.0, "gamma2": 0.01, "logp0": -3.0, "mu0x": 0.0, "mu0y": 0.0, "sigma02": 9.0})
    resp = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0, -1, 0.5), (0, 0.0, 0.0, 1.0, 1.0, 7, 0.5)], "id long, x double, y double, s2x double, s2y double, c long, r double")
    found = {r.c: r for r in elbo.gaps_delete(resp, model.components, model.scalars, model.prior).collect()}
    assert sorted(found) == list(range(n))
    for k in (0, 7, n - 1):
        want = elbo.gap_delete(resp, model.components, model.scalars, model.prior, k).first()
        assert np.allclose([found[k][x] for x in ("noise", "stick", "entropy", "obs")], [want[x] for x in ("noise", "stick", "entropy", "obs")], rtol=1e-9, atol=1e-5)


def test_sums_of_deletions_in_tasks(spark):
    points = generators.gaussian_grid(spark, 2, 20, pitch=60.0, s2=30.0, seed=3)
    model = fit.step(fit.start(points, views.cell_centres(points, pitch=40.0), fit.Config(prune=False)))
    want = {r.c: list(r)[1:] for r in elbo.deletion_sums(model.present()).collect()}
    found = {r.c: list(r)[1:] for r in near.deletion_sums(model.points, model.centres()).collect()}
    assert set(found) == set(want) and all(np.allclose(found[c], want[c]) for c in want)


def test_deletions_in_rounds_raise_the_bound(spark):
    points = generators.gaussian_grid(spark, 2, 20, pitch=60.0, s2=30.0, seed=3)
    model = fit.step(fit.start(points, views.cell_centres(points, pitch=15.0), fit.Config(prune=False)))
    after = fit.delete_all(model)
    assert after.elbo > model.elbo and after.components.count() < model.components.count()
    assert elbo.gaps_delete(after.responsibilities(), after.components, after.scalars, after.prior).where("gap > 0").count() == 0 or after.moves[("dead", False)] == 1
    assert sorted(r.c for r in after.components.collect()) == list(range(after.components.count()))


def test_moves_that_are_apart(spark):
    components = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 2.0, 0.0), (3, 50.0, 0.0)], "c long, mux double, muy double")
    gaps = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 3.0), (3, 0.5)], "c long, gap double")
    assert sorted(r.c for r in fit.apart(gaps, components, 1.5).collect()) == [1, 3]


def test_components_as_told(spark):
    """A global step after surgery has the counts of the changed responsibilities, and all mass stays."""
    points = generators.gaussian_grid(spark, 2, 20, pitch=60.0, s2=30.0, seed=3)
    model = fit.step(fit.start(points, views.cell_centres(points, pitch=40.0), fit.Config(prune=False)))
    resp = model.responsibilities().toPandas()
    mass = resp.groupby("c")["r"].sum()
    n = len(mass) - 1
    rk = lambda m: [r.rk for r in m.components.orderBy("c").collect()]
    assert np.allclose(rk(fit.delete_components(model, [1])), [mass[c] for c in range(n) if c != 1])
    assert np.allclose(rk(fit.merge_components(model, 0, 2)), [mass[0] + mass[2], *(mass[c] for c in range(1, n) if c != 2)])
    ids = model.points.where("x > 0").select("id")
    chosen = {r.id for r in ids.collect()}
    assert np.allclose(rk(fit.add_component(model, ids)), [resp[(resp.c == -1) & resp.id.isin(chosen)]["r"].sum(), *(mass[c] for c in range(n))])
    halves = model.responsibilities().where("c = 1").withColumn("r1", F.col("r") * 0.25).withColumn("r2", F.col("r") * 0.75)
    assert np.allclose(rk(fit.split_component(model, 1, halves)), [mass[0], mass[1] / 4, mass[1] * 0.75, *(mass[c] for c in range(2, n))])


def test_buckets_entropy_and_components_of_arrays(spark):
    values = spark.createDataFrame([(x,) for x in (0, 1, 4, 5, 9, 4999, 5000, -1, None)], "v long")
    assert {(r.bucket, r.n) for r in metrics.bucket_counts(values, "v", 5).collect()} == {(0, 3), (1, 2), (999, 1)}
    assert {(r.bucket, r.n) for r in metrics.bucket_counts(values, "v").collect()} == {(0, 1), (1, 1), (3, 2), (4, 1), (13, 2)}
    resp = spark.createDataFrame([(0, -1, 0.5), (0, 0, 0.5), (1, 0, 1e-12)], "id long, c long, r double")
    assert abs(estep.entropy(resp).first()["entropy"] - math.log(0.5)) < 1e-12
    found = files.in_memory_components(spark, [[1, 2], [3, 4]], [[5, 6], [7, 8]], [-1.0, -2.0]).orderBy("c").collect()
    assert [tuple(r) for r in found] == [(0, 1.0, 2.0, 5.0, 6.0, -1.0), (1, 3.0, 4.0, 7.0, 8.0, -2.0)]
    with pytest.raises(ValueError):
        files.in_memory_components(spark, [[1, 2]], [[5, 6]], [])
