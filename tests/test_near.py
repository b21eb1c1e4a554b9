"""The local step in tasks against that with a row for each pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixfield.operators import components as surgery
from mixfield.operators import estep, metrics, near
from mixfield.plans import fit, frames, registry
from mixfield.sources import views


def points_of(spark, n, seed=3, side=3000.0):
    rng = np.random.default_rng(seed)
    rows = [(i, int(f), *map(float, x), float(s), float(s) * 1.5) for i, (f, x, s) in enumerate(zip(rng.integers(0, 6, n), rng.uniform(0, side, (n, 2)), 10.0 ** rng.uniform(-1, 3, n), strict=True))]
    return spark.createDataFrame(rows, "id long, frame int, x double, y double, s2x double, s2y double").repartition(3)


@pytest.mark.parametrize("radius", [None, 4.0])
def test_what_is_left_out_is_zero(spark, radius):
    points = points_of(spark, 400)
    model = fit.start(points, views.cell_centres(points, 150.0), fit.Config(search_radius=radius))
    want = model.responsibilities().where("c = -1 or r > 0").toPandas().set_index(["id", "c"]).sort_index()
    got = model.present().toPandas().set_index(["id", "c"]).sort_index()
    both = want[["r", "logp"]].join(got[["r", "logp"]], rsuffix="_got", how="outer").fillna(0.0)
    assert np.allclose(both["r"], both["r_got"], rtol=1e-9, atol=1e-300)
    assert model.present([2, -1]).where("c not in (2, -1)").count() == 0
    stats = {r["c"]: r for r in fit.step_stats(model.responsibilities(), model.axes).collect()}
    for r in fit.local_stats(model).collect():
        assert np.allclose([r[k] for k in near.stat_names()[1:]], [stats[r["c"]][k] for k in near.stat_names()[1:]], rtol=1e-8, atol=1e-9)


def test_rows_of_frames(spark):
    points = points_of(spark, 300)
    model = frames.start(points, views.cell_centres(points, 150.0))
    want = model.responsibilities().where("c = -1 or r > 0").agg(F.count("*"), F.sum(F.col("r") * F.col("r"))).first()
    got = model.present().agg(F.count("*"), F.sum(F.col("r") * F.col("r"))).first()
    assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9


def test_step_of_many_components(spark):
    """More components than one array of a row may have."""
    points = points_of(spark, 200)
    centres = spark.range(25_000).select(F.col("id").alias("c"), (F.col("id") % 250 * 12.0).alias("mux"), (F.floor(F.col("id") / 250) * 30.0).alias("muy"), F.lit(1.0).alias("vx"), F.lit(1.0).alias("vy"), F.lit(1).alias("n"))
    model = fit.step(fit.start(points, views.with_counts(centres)))
    assert model.components.count() == 25_000
    mass = model.components.agg(F.sum("rk")).first()[0]
    assert abs(mass + model.scalars.a - model.prior["a"] - 200) < 1e-6


def test_order_of_centres_does_not_depend_on_last_digits(spark):
    rows = [(0, 0.1 + 0.2, 9.0), (1, 0.3, 8.0), (2, 0.3, 9.0 - 1e-12), (3, -1.0, 5.0)]
    found = metrics.sorted_centres(spark.createDataFrame(rows, "c long, mux double, muy double")).orderBy("c").collect()
    assert [(r.mux, r.muy) for r in found] == [(-1.0, 5.0), (0.3, 8.0), (0.1 + 0.2, 9.0), (0.3, 9.0 - 1e-12)]


def test_every_pair_of_more_components_than_fit_into_a_row_and_of_points_without_a_place(spark):
    n = 20_500
    components = spark.range(n).select(F.col("id").alias("c"), (F.col("id") * 3.0).alias("mux"), F.lit(1.0).alias("muy"), F.lit(0.5).alias("vx"), F.lit(0.5).alias("vy"), F.lit(-9.0).alias("log_weight"))
    points = spark.createDataFrame([(1, 30.0, 2.0, 4.0, 4.0), (2, None, 1.0, 4.0, 4.0), (3, 1e7, 1.0, 4.0, 4.0)], "id long, x double, y double, s2x double, s2y double")
    assert estep.log_likelihood(points, components).count() == 3 * n
    found = estep.every_pair(near.with_totals(points, near.sent(components, -14.0)), components, -14.0).toPandas().set_index(["id", "c"]).sort_index()
    assert len(found) == 3 * (n + 1)
    logs = np.array([-14.0, *(-9.0 - math.log(2 * math.pi) - math.log(4) - ((30 - 3 * c) ** 2 + 0.5) / 8 - 1.5 / 8 for c in range(n))])
    r = np.exp(logs - logs.max())
    assert np.allclose(found.loc[1].logp, logs) and np.allclose(found.loc[1].r, r / r.sum(), atol=1e-14) and abs(found.loc[1].r.sum() - 1) < 1e-12
    assert found.loc[2, -1].r == 1 and found.loc[2].r.notna().sum() == 1 and found.loc[2].logp.notna().sum() == 1
    assert found.loc[3, -1].r == 1 and found.loc[3].r.sum() == 1


def test_rounding_without_decimals(spark):
    values = [0.0005, -0.0005, 2.0005, -1.2345678, 0.0, 1e14, -3e20, 1e300, None, float("nan"), float("inf")]
    found = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(estep.rounded(F.col("v"), 3).alias("v")).collect()]
    assert found[:6] == [0.001, -0.001, 2.001, -1.235, 0.0, 1e14] and found[6:9] == [-3e20, 1e300, None] and math.isnan(found[9]) and found[10] == math.inf


def test_surgery_deals_out_only_rows_that_change(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    names = "id long, x double, y double, s2x double, s2y double, c long, r double"
    resp = spark.createDataFrame([(i, 1.0, 2.0, 3.0, 4.0, c, 0.1 * (c + 2)) for i in (1, 2) for c in range(-1, 3)], names)
    rows = lambda df: sorted((r.id, r.c, round(r.r, 9)) for r in df.collect())
    both = lambda found: sorted((i, c, r) for i in (1, 2) for c, r in found.items())
    removed, merged = surgery.remove(resp, [1]), surgery.merge(resp, 0, 2)
    assert rows(removed) == both({-1: 0.4, 0: 0.2, 1: 0.4}) and rows(merged) == both({-1: 0.1, 0: 0.6, 1: 0.3})
    assert rows(surgery.remove(resp, [0, 1, 2])) == both({-1: 1.0}) and rows(surgery.remove(resp, list(range(40)))) == both({-1: 1.0})
    assert rows(surgery.insert_from_noise(resp, spark.createDataFrame([(2,)], "id long"))) == sorted([(1, -1, 0.1), (2, 0, 0.1)] + [(i, c + 1, round(0.1 * (c + 2), 9)) for i in (1, 2) for c in range(3)])
    # what doesn't change comes without a group or a join
    for df in (removed, merged):
        assert "Union" in plan(df) and "c#" not in plan(df).split("Physical Plan")[-1].split("hashpartitioning(")[1].split("ENSURE")[0]


def test_points_of_one_id_are_added_up(spark):
    rows = [(1, 10.0, 10.0), (1, 12.0, 10.0), (2, 60.0, 10.0), (None, 10.0, 60.0), (None, 11.0, 60.0)]
    points = spark.createDataFrame([(*r, 4.0, 4.0) for r in rows], "id long, x double, y double, s2x double, s2y double")
    model = fit.start(points, views.cell_centres(points), fit.Config(prune=False))
    want = {(r.id, r.c): r.r for r in model.responsibilities().groupBy("id", "c").agg(F.sum("r").alias("r")).collect()}
    found = registry._shown_resp(model, lambda resp: resp).collect()
    assert len(found) == len(want) == 3 * 4 and all(abs(want[r.id, r.c] - r.r) < 1e-4 for r in found)
