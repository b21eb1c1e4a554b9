"""Steps read their source once, look at few components for a point, and sum runs of components."""

import numpy as np
from pyspark.sql import functions as F

from mixfield.operators import mstep, near, temporal
from mixfield.plans import fit, registry
from mixfield.sources import views


def points_of(spark, n=300, side=900.0):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, x), float(s), float(s)) for i, (x, s) in enumerate(zip(rng.uniform(0, side, (n, 2)), rng.uniform(1, 9, n), strict=True))]
    return spark.createDataFrame(rows, "id long, x double, y double, s2x double, s2y double").repartition(3)


def test_source_is_read_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    points = points_of(spark)
    monkeypatch.setattr(registry, "_points", lambda spark, folder: points.mapInArrow(counted, points.schema))
    model = registry._setup(spark, "")
    assert fit.step(model).components.count() > 1 and read.value == 300


def test_few_components_are_looked_at_on_a_wide_field():
    rng = np.random.default_rng(1)
    mu = rng.uniform(0, 1e6, (50_000, 2))
    centres = near.Centres(np.arange(len(mu)), mu, np.ones((len(mu), 2)), np.zeros(len(mu)), 0.0)
    reach2 = rng.uniform(100.0**2, 200.0**2, 500)
    x = mu[:500] + 50.0
    found = {(int(rows[a]), int(k)) for rows, at, near_k in centres.pairs(x, reach2) for a, k in zip(at, near_k, strict=True)}
    d2 = ((x[:, None] - mu[None]) ** 2).sum(axis=2)
    assert found == set(zip(*map(lambda v: v.tolist(), np.nonzero(d2 < reach2[:, None])), strict=True))
    assert max(g.size for g in centres.grids.values()) < 200


def test_runs_of_components_are_one_model(spark, monkeypatch):
    points = points_of(spark)
    model = fit.start(points, views.cell_centres(points, 100.0), fit.Config(prune=False))
    whole = fit.step(fit.step(model))
    monkeypatch.setattr(mstep, "RUN", 10)
    parts = fit.step(fit.step(model))
    assert abs(whole.elbo - parts.elbo) < 1e-6 and whole.few == parts.few
    names = [n for n in whole.components.columns if n != "c"]
    a, b = (m.components.orderBy("c").select(*names).toPandas().to_numpy() for m in (whole, parts))
    assert len(a) == whole.components.agg(F.countDistinct("c")).first()[0] > 20 and np.allclose(a, b, rtol=1e-9)


def test_short_chains_are_no_groups_of_their_own(spark):
    """Chains of several lengths, side by side in one task, against each by itself."""
    rng = np.random.default_rng(2)
    rows = [(s, t, rng.normal(0, 4, 2).tolist()) for s in range(40) for t in range(1 + s % 7)]
    steps = spark.createDataFrame(rows, "seq long, t int, logp array<double>").repartition(5)
    start, moves = np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.3, 0.7]])
    for block in (2, 100):
        smoothed = temporal.smooth(steps, start.tolist(), moves.tolist(), block)
        assert "_group" in smoothed._jdf.queryExecution().toString()
        found = smoothed.orderBy("seq", "t").collect()
        assert len(found) == len(rows)
        for s in range(40):
            want, _, evidence = temporal.forward_backward(np.array([r[2] for r in rows if r[0] == s]), start, moves)
            own = [r for r in found if r.seq == s]
            assert np.allclose([r.p for r in own], want) and abs(own[0].log_evidence - evidence) < 1e-9
