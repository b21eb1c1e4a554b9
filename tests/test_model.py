import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

import twin
from mixfield.operators import components as ops
from mixfield.operators import elbo, estep, mstep
from mixfield.operators.storage import written
from mixfield.plans import fit
from mixfield.sources import generators, views


@pytest.fixture(scope="module")
def setup(spark):
    points = generators.gaussian_grid(spark, 2, 20, pitch=60.0, s2=30.0, seed=3).cache()
    model = fit.step(fit.start(points, views.cell_centres(points, pitch=40.0), fit.Config(prune=False)))
    rows = points.orderBy("id").toPandas()
    return model, rows[["x", "y"]].to_numpy(), rows[["s2x", "s2y"]].to_numpy()


def arrays(model):
    c = model.components.orderBy("c").toPandas()
    s = model.scalars
    return c[["mux", "muy"]].to_numpy(), c[["vx", "vy"]].to_numpy(), c["eta1"].to_numpy(), c["eta0"].to_numpy(), c["log_weight"].to_numpy(), (s.a, s.b, s.gamma1, s.gamma2)


def dense_r(model):
    rows = model.responsibilities().select("id", "c", "r").toPandas()
    return rows.pivot(index="id", columns="c", values="r").sort_index().sort_index(axis=1).to_numpy()


def test_local_step(setup):
    model, x, s2 = setup
    mu, v, eta1, eta0, lw, (a, b, _, _) = arrays(model)
    logit = float(twin.digamma(a) - twin.digamma(b)) + model.prior["logp0"]
    want = twin.estep(x, s2, mu, v, lw, logit)
    got = dense_r(model)
    assert np.allclose(got, want, atol=1e-8) and np.allclose(got.sum(1), 1)


def test_global_step_and_bound(setup):
    model, x, s2 = setup
    r = dense_r(model)
    after = fit.step(model)
    rk, xx, sx = twin.after(x, s2, r)
    mu, v = twin.centres(xx, sx, model.prior)
    got = arrays(after)
    assert np.allclose(got[0], mu) and np.allclose(got[1], v) and np.allclose(got[2], 1 + rk)
    assert np.allclose(got[3], model.scalars.alpha + rk[::-1].cumsum()[::-1] - rk)
    want = twin.elbo(x, s2, r, mu, v, got[2], got[3], got[5], model.prior)
    assert abs(after.elbo - want.sum()) < 1e-6 * abs(want.sum())


def test_bound_does_not_fall(setup):
    model, _, _ = setup
    for infer in (True, False):
        m = fit.start(model.points, views.cell_centres(model.points, pitch=40.0), fit.Config(prune=False, infer_alpha0=infer))
        trace = []
        for _ in range(5):
            m = fit.step(m)
            trace.append(m.elbo)
        assert all(b >= a - 1e-4 for a, b in zip(trace, trace[1:]))


def sticks(eta1, eta0):
    both = twin.digamma(eta1 + eta0)
    return twin.digamma(eta1) - both, twin.digamma(eta0) - both


def changed(model, x, s2, r, r_after, mu, v, eta1, eta0, scalars):
    """The change of the bound to another configuration, from all points and components."""
    m0, v0, e1, e0, _, sc = arrays(model)
    return twin.elbo(x, s2, r_after, mu, v, eta1, eta0, scalars, model.prior) - twin.elbo(x, s2, r, m0, v0, e1, e0, sc, model.prior)


def test_gap_of_a_deletion_is_the_change_of_the_bound(setup):
    model, x, s2 = setup
    resp = model.responsibilities()
    r = dense_r(model)
    # shares and scalars of exactly these responsibilities
    same = fit.step(model, from_resp=resp)
    k = 1
    got = elbo.gap_delete(resp, same.components, same.scalars, same.prior, k).first()
    mu, v, eta1, eta0, _, (a, b, g1, g2) = arrays(same)
    s = r[:, 1 + k].sum()
    after = np.delete(r, 1 + k, 1)
    after[:, 0] += r[:, 1 + k]
    gone = sticks(eta1, eta0)[1][k]
    scal = (a + s, b - s, g1 - 1, g2 + gone)
    rest = np.delete(np.arange(len(mu)), k)
    e0 = eta0.copy()
    e0[:k] -= s
    e0 += scal[2] / scal[3] - g1 / g2
    want = changed(same, x, s2, r, after, mu[rest], v[rest], eta1[rest], e0[rest], scal)
    assert np.allclose([got.noise, got.stick, got.entropy, got.obs], want, atol=1e-5)


def test_gap_of_a_merge_is_the_change_of_the_bound(setup):
    model, x, s2 = setup
    resp = model.responsibilities()
    r = dense_r(model)
    same = fit.step(model, from_resp=resp)
    k1, k2 = 0, 2
    got = elbo.gap_merge(resp, same.components, same.scalars, same.prior, k1, k2).first()
    mu, v, eta1, eta0, _, (a, b, g1, g2) = arrays(same)
    after = r.copy()
    after[:, 1 + k1] += after[:, 1 + k2]
    after = np.delete(after, 1 + k2, 1)
    rk, xx, sx = twin.after(x, s2, after)
    new_mu, new_v = twin.centres(xx, sx, same.prior)
    scal = (a, b, g1 - 1, g2 + sticks(eta1, eta0)[1][k2])
    base = eta0 - ((eta1 - 1)[::-1].cumsum()[::-1] - (eta1 - 1))
    e0 = np.delete(base, k2) + rk[::-1].cumsum()[::-1] - rk + scal[2] / scal[3] - g1 / g2
    want = changed(same, x, s2, r, after, new_mu, new_v, 1 + rk, e0, scal)
    assert np.allclose([got.noise, got.stick, got.entropy, got.obs], want, atol=1e-5)


def test_gap_of_a_split_is_the_change_of_the_bound(setup):
    model, x, s2 = setup
    resp = model.responsibilities()
    r = dense_r(model)
    same = fit.step(model, from_resp=resp)
    k = 1
    share = (x[:, 0] > np.median(x[:, 0])) * 0.8 + 0.1
    proposed = resp.where(F.col("c") == k).withColumn("r1", F.col("r") * (F.when(F.col("x") > float(np.median(x[:, 0])), 0.8).otherwise(0.0) + 0.1))
    proposed = proposed.withColumn("r2", F.col("r") - F.col("r1"))
    got = elbo.gap_split(proposed, same.components, same.scalars, same.prior, k).first()
    mu, v, eta1, eta0, _, (a, b, g1, g2) = arrays(same)
    after = np.insert(r, 2 + k, 0, axis=1)
    after[:, 1 + k], after[:, 2 + k] = r[:, 1 + k] * share, r[:, 1 + k] * (1 - share)
    rk, xx, sx = twin.after(x, s2, after)
    new_mu, new_v = twin.centres(xx, sx, same.prior)
    logs = sticks(eta1, eta0)[1]
    scal = (a, b, g1 + 1, same.prior["gamma2"] - logs.sum() + logs[k])
    base = eta0 - ((eta1 - 1)[::-1].cumsum()[::-1] - (eta1 - 1))
    e0 = np.insert(base, k + 1, base[k]) + rk[::-1].cumsum()[::-1] - rk + scal[2] / scal[3] - g1 / g2
    want = changed(same, x, s2, r, after, new_mu, new_v, 1 + rk, e0, scal)
    assert np.allclose([got.noise, got.stick, got.entropy, got.obs], want, atol=1e-5)


MODES = [dict(infer_pi1=False), dict(infer_alpha0=False), dict(infer_pi1=False, infer_alpha0=False)]


@pytest.mark.parametrize("mode", MODES)
def test_bound_with_fixed_values(setup, mode):
    """The bound of a fixed share of noise or concentration by its formula, over all points and components."""
    start, x, s2 = setup
    model = fit.start(start.points, views.cell_centres(start.points, pitch=40.0), fit.Config(prune=False, **mode))
    resp = model.responsibilities()
    r = dense_r(model)
    after = fit.step(model, from_resp=resp)
    got = elbo.bound(elbo.resp_sums(resp), after.components, after.scalars, after.prior).first()
    pi1, alpha0, logp0 = after.prior["pi1"], after.prior["alpha0"], after.prior["logp0"]
    mu, v, eta1, eta0, _, sc = arrays(after)
    inferred = twin.elbo(x, s2, r, mu, v, eta1, eta0, sc, after.prior)
    noise = r[:, 0].sum() * (math.log(pi1 / (1 - pi1)) + logp0) + len(x) * math.log(1 - pi1) if "infer_pi1" in mode else inferred[0]
    c_beta = lambda a, b: math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    stick = len(mu) * c_beta(1.0, alpha0) - sum(map(c_beta, eta1, eta0)) if "infer_alpha0" in mode else inferred[1]
    assert np.allclose([got.e_noise, got.e_sb, got.e_ent, got.e_obs], [noise, stick, inferred[2], inferred[3]], atol=1e-5)
    if "infer_alpha0" in mode:
        assert np.allclose(eta0, alpha0 + (eta1 - 1)[::-1].cumsum()[::-1] - (eta1 - 1))


def change(before, sums, after, sums_after):
    terms = lambda m, s: np.array([elbo.bound(s, m.components, m.scalars, m.prior).first()[n] for n in ("e_noise", "e_sb", "e_ent", "e_obs")])
    return terms(after, sums_after) - terms(before, sums)


@pytest.mark.parametrize("mode", [dict(infer_alpha0=False), dict(infer_pi1=False, infer_alpha0=False)])
def test_gaps_with_fixed_values_are_changes_of_the_bound(setup, mode):
    """Each gap against the bounds of two whole configurations, made by steps from the responsibilities before and after."""
    start, x, _ = setup
    model = fit.start(start.points, views.cell_centres(start.points, pitch=40.0), fit.Config(prune=False, **mode))
    resp = written(model.responsibilities(), "resp")
    same, sums = fit.step(model, from_resp=resp), elbo.resp_sums(resp)
    spark = resp.sparkSession

    def moved(resp_after, n):
        numbers = spark.range(n).withColumnRenamed("id", "c").join(same.components.drop("c").limit(1), how="cross")
        m = fit.step(replace(same, components=numbers.select(*same.components.columns)), from_resp=written(resp_after, "after"))
        return change(same, sums, m, elbo.resp_sums(resp_after))

    n = same.components.count()
    check = lambda row, want: np.testing.assert_allclose([row.noise, row.stick, row.entropy, row.obs], want, atol=1e-5)
    check(elbo.gap_delete(resp, same.components, same.scalars, same.prior, 1).first(), moved(ops.remove(resp, [1]), n - 1))
    check(elbo.gap_merge(resp, same.components, same.scalars, same.prior, 0, 2).first(), moved(ops.merge(resp, 0, 2), n - 1))
    at = float(np.median(x[:, 0]))
    proposed = resp.where("c = 1").withColumn("r1", F.col("r") * F.when(F.col("x") > at, 0.9).otherwise(0.1)).withColumn("r2", F.col("r") - F.col("r1"))
    check(elbo.gap_split(proposed, same.components, same.scalars, same.prior, 1).first(), moved(ops.split(resp, 1, proposed), n + 1))
    chosen = resp.where("c = -1 and x > 20")
    check(elbo.gap_birth(chosen, same.components, same.scalars, same.prior).first(), moved(ops.insert_from_noise(resp, chosen), n + 1))


@pytest.mark.parametrize("gone", [[3], [0, 2, 7], list(range(1, 60, 2))])
def test_renumbering(spark, gone):
    rows = spark.createDataFrame([(c, c) for c in range(-1, 80)], "c long, was long")
    kept = [c for c in range(80) if c not in gone]
    found = {r.was: r.c for r in ops.renumber(rows, gone).collect()}
    assert found == {-1: -1} | {c: i for i, c in enumerate(kept)}


def test_fit_finds_the_grid(spark):
    points = generators.with_noise(generators.gaussian_grid(spark, 2, 30, pitch=80.0, s2=25.0, seed=5), 0.05, 2).cache()
    model = fit.fit(fit.start(points, fit.initial_centres(points, "density_peaks"), fit.Config(iterations=8, search_radius=6.0)))
    big = model.components.where("rk > 5").toPandas()
    assert big.rk.sum() > 100
    for tx in (0, 80):
        for ty in (0, 80):
            assert np.hypot(big.mux - tx, big.muy - ty).min() < 4
    assert model.history_table().count() == len(model.history)


def test_moves(spark):
    points = generators.gaussian_grid(spark, 2, 25, pitch=60.0, s2=16.0, seed=8).cache()
    one = points.agg(F.avg("x").alias("mux"), F.avg("y").alias("muy")).select(F.lit(0).cast("long").alias("c"), "mux", "muy", F.lit(16.0).alias("vx"), F.lit(16.0).alias("vy"), F.lit(100).alias("n"))
    # one centre takes two of the four clusters
    left = points.where("x < 30")
    pair = left.agg(F.avg("x").alias("mux"), F.avg("y").alias("muy")).select(F.lit(0).cast("long").alias("c"), "mux", "muy", F.lit(16.0).alias("vx"), F.lit(16.0).alias("vy"), F.lit(50).alias("n"))
    config = fit.Config(prune=False, propagate_rounds=3, infer_pi1=False)
    prior = views.priors(left) | {"logp0": -30.0}
    model = fit.step(fit.step(fit.start(left, views.with_counts(pair), config, prior)))
    after = fit.split(model, 0, seeds=2)
    assert after.moves == {("split", True): 1} and after.components.count() == 2 and after.elbo > model.elbo
    none = fit.step(fit.start(points, views.with_counts(one).limit(0), fit.Config(prune=False)))
    born = fit.birth(none)
    assert born.moves == {("birth", True): 1} and born.components.count() == 1
    assert fit.delete(none).components.count() == 0
    double = views.cell_centres(left, pitch=30.0)
    merged = fit.merge(fit.step(fit.start(left, double, config, prior)), 0)
    assert sum(merged.moves.values()) >= 1
    assert {r.move: r.accepted for r in merged.moves_table().collect()}["split"] == 0


def test_schedules_run(spark):
    points = generators.gaussian_grid(spark, 1, 20, s2=9.0, seed=1).cache()
    start = fit.start(points, views.cell_centres(points, pitch=20.0), fit.Config(propagate_rounds=1))
    assert math.isfinite(fit.fit_moves(start, 3).elbo)
    assert fit.refine(fit.step(start)).components.count() >= 1


def test_surgery_keeps_mass(spark):
    rows = [(i, float(i), 0.0, 1.0, 1.0, c, r) for i in range(4) for c, r in ((-1, 0.1), (0, 0.2), (1, 0.3), (2, 0.4))]
    resp = spark.createDataFrame(rows, "id long, x double, y double, s2x double, s2y double, c long, r double")

    def by(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.id, {})[r.c] = round(r.r, 9)
        return out

    assert by(ops.remove(resp, [0, 2]))[0] == {-1: 0.7, 0: 0.3}
    assert by(ops.merge(resp, 0, 2))[1] == {-1: 0.1, 0: 0.6, 1: 0.3}
    proposed = resp.where("c = 1").withColumn("r1", F.col("r") * 0.25).withColumn("r2", F.col("r") * 0.75)
    assert by(ops.split(resp, 1, proposed))[2] == {-1: 0.1, 0: 0.2, 1: 0.075, 2: 0.225, 3: 0.4}
    born = by(ops.insert_from_noise(resp, spark.createDataFrame([(0,)], "id long")))
    assert born[0] == {0: 0.1, 1: 0.2, 2: 0.3, 3: 0.4} and born[1] == {-1: 0.1, 1: 0.2, 2: 0.3, 3: 0.4}
    with pytest.raises(ValueError):
        ops.merge(resp, 2, 1)
    with pytest.raises(ValueError):
        ops.remove(resp, [-1])
    with pytest.raises(ValueError):
        ops.require(resp, c="string")
    assert ops.append_empty(spark.createDataFrame([(0, 1.0)], "c long, rk double"), 2).orderBy("c").collect()[2].asDict() == {"c": 2, "rk": 0.0}


def test_running_sums_over_runs(spark, monkeypatch):
    monkeypatch.setattr(mstep, "RUN", 3)
    rows = spark.range(10).select(F.col("id").alias("c"), (F.col("id") * 1.0).alias("v"))
    after = {r.c: r.s for r in mstep.running_sums(rows, "v", "s", True).collect()}
    before = {r.c: r.s for r in mstep.running_sums(rows, "v", "s", False).collect()}
    assert after == {c: sum(range(c + 1, 10)) for c in range(10)} and before == {c: sum(range(c)) for c in range(10)}


def test_running_sums_of_a_long_run_add_up_once(spark):
    rows = spark.range(5000).select(F.col("id").alias("c"), (F.col("id") % 7 * 1.0).alias("v"))
    for after in (True, False):
        found = mstep.running_sums(rows, "v", "s", after)
        sums = {r.c: r.s for r in found.collect()}
        assert [sums[c] for c in range(5000)] == [sum(k % 7 for k in (range(c + 1, 5000) if after else range(c))) for c in range(5000)]
        # a frame that ends with the last row is added up anew for each row
        assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()


def test_softmax_options(spark):
    rows = spark.createDataFrame([(1, 0, 0.0), (1, 1, -60.0), (1, 2, -1.0)], "id long, c long, logp double")
    plain = {r.c: r.r for r in estep.softmax(rows).collect()}
    cut = {r.c: r.r for r in estep.softmax(rows, -50.0).collect()}
    clipped = {r.c: r.r for r in estep.softmax(rows, clip=7.0).collect()}
    assert plain[1] > 0 and cut[1] == 0 and clipped[1] > plain[1]
    assert abs(sum(plain.values()) - 1) < 1e-12 and abs(sum(cut.values()) - 1) < 1e-12


def test_registered_fit_and_split_are_whole(spark, monkeypatch):
    from mixfield.plans import registry

    asked = {}
    monkeypatch.setattr(registry.fit, "fit", lambda model: asked.update(fit=model.config) or model)
    monkeypatch.setattr(registry.fit, "split", lambda model, k, seeds=9: asked.update(split=model.config, seeds=seeds) or model)
    for name in ("fit_full", "split_move"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    whole = fit.Config()
    assert (asked["fit"].iterations, asked["fit"].tolerance) == (whole.iterations, whole.tolerance)
    assert (asked["split"].propagate_rounds, asked["seeds"]) == (whole.propagate_rounds, 9)
