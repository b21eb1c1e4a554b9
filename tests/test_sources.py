import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixfield.operators import metrics
from mixfield.sources import files, generators, views


def test_text_files(spark, tmp_path):
    (tmp_path / "points.txt").write_text("3\n1 2 0.5 0.6\n3 4 0.7 0.8\n5 6 0.9 1.0\n")
    (tmp_path / "centers.txt").write_text("2\n2\n0\n")
    (tmp_path / "k.txt").write_text("1 2\n9 9\n1 2\n3 4\n")
    points = files.read_points(spark, str(tmp_path / "points.txt"))
    assert [tuple(r) for r in points.orderBy("id").collect()] == [(0, 1.0, 2.0, 0.5, 0.6), (1, 3.0, 4.0, 0.7, 0.8), (2, 5.0, 6.0, 0.9, 1.0)]
    centres = files.read_centres(spark, str(tmp_path / "centers.txt"), points)
    assert [(r.c, r.mux) for r in centres.orderBy("c").collect()] == [(0, 5.0), (1, 1.0)]
    seeds, rows = files.read_kmeans(spark, str(tmp_path / "k.txt"))
    assert [tuple(r) for r in seeds.collect()] == [(0, 9.0, 9.0)] and rows.count() == 2


def test_csv_stays_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b;c\n1;2;x\n")
    rows = files.read_columns(spark, str(tmp_path / "a.csv"), ["c", "a"], ";")
    assert rows.dtypes == [("c", "string"), ("a", "string")] and tuple(rows.first()) == ("x", "1")


def test_datasets(spark, tmp_path):
    raw = spark.createDataFrame([tuple(float(i) for i in range(10))], [f"_{i}" for i in range(10)])
    raw.write.parquet(str(tmp_path / "raw"))
    one = files.read_dataset(spark, "origami-af647", str(tmp_path / "raw")).first()
    assert (one.frame, one.x, one.y, one.s2x) == (0, 1.0, 2.0, 6.4)
    two = files.read_dataset(spark, "origami-dynein", str(tmp_path / "raw")).first()
    assert (two.frame, two.x, two.y, two.s2y) == (1, 2.0, 3.0, 81.0)
    with pytest.raises(ValueError, match="origami-af647"):
        files.read_dataset(spark, "none", "")
    assert files.detect(5)[0] == "frame" and files.detect(6)[2] == "z"
    with pytest.raises(ValueError):
        files.detect(3)


def test_model_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.5)], "c long, mux double")
    files.save_model(rows, {"a": 1.0, "b": 2.0}, str(tmp_path / "m"))
    components, scalars = files.load_model(spark, str(tmp_path / "m"))
    assert components.collect() == rows.collect() and scalars == {"a": 1.0, "b": 2.0}
    files.dump_state(rows, rows, rows, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/components")).count() == 1


def test_in_memory_and_priors(spark):
    points = files.in_memory_points(spark, {"x": [0.0, 10.0], "y": [0.0, 5.0], "s2x": [1.0, 3.0], "s2y": [1.0, 3.0]})
    p = views.priors(points, pi1=0.2)
    assert p["area"] == 50 and p["sigma02"] == 2500 and p["pi1"] == 0.2 and abs(p["mean_sigma"] - math.sqrt(2)) < 1e-12
    assert views.priors(points.limit(1))["area"] == 1.0
    assert views.priors(points.limit(0))["n"] == 0


def test_generators_agree_with_themselves(spark):
    points = generators.gaussian_grid(spark, 2, 50)
    assert points.count() == 200
    noisy = generators.with_noise(points, 0.3, 4)
    noise = noisy.where("truth = -1").toPandas()
    assert 30 < len(noise) < 90 and set(noise.id) == set(generators.with_noise(points.repartition(7), 0.3, 4).where("truth = -1").toPandas().id)
    box = points.agg(F.min("x"), F.max("x")).first()
    half = (box[1] - box[0]) / 2
    assert noise.x.between(box[0] - half, box[1] + half).all()
    hot = generators.one_hot(noisy, 4).toPandas()
    assert (hot.drop(columns="id").sum(axis=1) == 1).all() and hot.z0.sum() == len(noise)


def test_two_sources_and_grid(spark):
    rows = generators.gaussian_grid(spark, 2, 40).withColumn("source", F.col("truth")).withColumn("frame", F.lit(3))
    two = generators.two_sources(rows, 0, 3, 25.0, delay=10)
    means = {r.truth: (r.mux, r.muy) for r in metrics.weighted_means(two, "truth").collect()}
    assert np.allclose([*means[0], *means[1]], [0, 0, 25, 0], atol=1e-9)
    assert {r.frame for r in two.where("truth = 1").select("frame").distinct().collect()} == {13}
    grid, places = generators.grid_of_sources(rows, 3, 50.0, 1)
    found = metrics.weighted_means(grid, "truth").withColumnRenamed("truth", "c")
    match = metrics.nearest_truth(found, places)
    one = metrics.distance_metric(match).first()
    assert one.n == 9 and one.mean_d < 1e-9 and match.where("c <> truth").count() == 0


def test_statistics(spark):
    rng = np.random.default_rng(0)
    for sample in (rng.standard_normal(400), rng.random(300), np.repeat([1.0, 2.0, 3.0], 5)):
        rows = spark.createDataFrame([(float(v),) for v in sample], "v double").repartition(5)
        got = metrics.ks_statistic(rows, "v").first()
        z = np.sort((sample - sample.mean()) / sample.std())
        cdf = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
        n = len(z)
        want = max(np.max(np.searchsorted(z, z, "right") / n - cdf), np.max(cdf - np.searchsorted(z, z, "left") / n))
        assert got.n == n and abs(got.d - want) < 1e-6


def test_probability_of_a_distance(spark):
    # known values of the limiting distribution
    rows = spark.createDataFrame([(0.5, 1), (1.0, 1), (1.36, 1), (0.05, 4)], "d double, n long")
    got = [r.p for r in rows.select("d", metrics.kolmogorov_p(F.col("d"), F.col("n")).alias("p")).collect()]
    assert np.allclose(got, [0.9639452, 0.2699997, 0.0494859, 1.0], atol=1e-5)


def test_ratio_from_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for group, shift in ((0, 0.0), (1, 3.0)):
        a, b = rng.normal(0, 1, 60), rng.normal(shift, 2, 80)
        gaps = (a[:, None] - b[None, :]).ravel()
        h = gaps.std(ddof=1) * len(gaps) ** -0.2
        want[group] = (np.exp(-0.5 * (gaps / h) ** 2) / (h * math.sqrt(2 * math.pi))).mean() * 10 * math.sqrt(2 * math.pi)
        rows += [(group, 0, float(v)) for v in a] + [(group, 1, float(v)) for v in b]
    df = spark.createDataFrame(rows, "separation long, side int, v double").repartition(4)
    left, right = (df.where(F.col("side") == k).drop("side") for k in (0, 1))
    got = {r.separation: r.factor for r in metrics.pairwise_factor(left, right, "v", 10.0, "separation").collect()}
    assert all(abs(got[g] - want[g]) < 0.01 * want[g] for g in want)
    only = metrics.pairwise_factor(left.where("separation = 0"), right.where("separation = 0"), "v", 10.0).first()
    assert abs(only.factor - got[0]) < 1e-9 and only.n == 4800
    report = {r.separation: r for r in metrics.comparison_report(left, right, "v", 10.0).collect()}
    assert report[1].low < report[1].distance < report[1].high and report[0].factor > report[1].factor


def test_centres_are_sorted_by_rows(spark):
    rows = spark.createDataFrame([(0, 5.0, 1.0), (1, 2.0, 9.0), (2, 2.0, 3.0)], "c long, mux double, muy double")
    assert [(r.c, r.mux, r.muy) for r in metrics.sorted_centres(rows).orderBy("c").collect()] == [(0, 2.0, 3.0), (1, 2.0, 9.0), (2, 5.0, 1.0)]
