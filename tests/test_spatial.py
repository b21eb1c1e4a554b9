import math
import random
from itertools import product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mixfield.operators import estep, spatial
from mixfield.operators.graph import components, label_components

COORD = st.floats(-100, 100, allow_nan=False)


def frame(spark, points):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double")


def near(points, radius):
    return {(i, j) for i, j in product(range(len(points)), repeat=2) if (points[i][0] - points[j][0]) ** 2 + (points[i][1] - points[j][1]) ** 2 <= radius * radius}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(points=st.lists(st.tuples(COORD, COORD), max_size=40), radius=st.floats(0.5, 60))
def test_range_join_is_the_filtered_product(spark, points, radius):
    rows = frame(spark, points)
    found = [(r.l_id, r.r_id) for r in spatial.range_join(rows, rows, radius).select("l_id", "r_id").collect()]
    assert len(found) == len(set(found)) and set(found) == near(points, radius)


def test_range_join_in_three_dimensions(spark):
    rng = random.Random(1)
    points = [(i, *(rng.uniform(-20, 20) for _ in range(3))) for i in range(60)]
    rows = spark.createDataFrame(points, "id long, x double, y double, z double")
    found = {(r.l_id, r.r_id) for r in spatial.range_join(rows, rows, 9.0, tuple("xyz")).collect()}
    assert found == {(a[0], b[0]) for a in points for b in points if sum((p - q) ** 2 for p, q in zip(a[1:], b[1:])) <= 81}


def test_adaptive_radius_over_wide_variances(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(0, 100), rng.uniform(0, 100), s2 := 10 ** rng.uniform(-2, 2), s2 * 1.5) for i in range(80)]
    centres = [(c, rng.uniform(0, 100), rng.uniform(0, 100)) for c in range(40)]
    p = spark.createDataFrame(points, "id long, x double, y double, s2x double, s2y double")
    k = spark.createDataFrame(centres, "c long, mux double, muy double").withColumns({"vx": F.lit(1.0), "vy": F.lit(1.0), "log_weight": F.lit(0.0)})
    found = sorted((r.id, r.c) for r in estep.near_pairs(p, k, 4.0).collect())
    want = sorted((a[0], c[0]) for a in points for c in centres if (a[1] - c[1]) ** 2 + (a[2] - c[2]) ** 2 < 16 * (a[3] + a[4]) / 2)
    assert found == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
def test_components(spark, edges):
    label = list(range(16))
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    rows = spark.createDataFrame(edges, "a long, b long")
    found = {r.id: r.label for r in label_components(spark.range(16), rows).collect()}
    assert found == dict(enumerate(label))


def test_a_long_chain_is_one_component(spark):
    rows = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.root) for r in components(rows).collect()} == {0}


def peaks(points, gk=35.0):
    n = [sum(math.dist(p, q) <= gk for q in points) for p in points]
    order = sorted(range(len(points)), key=lambda i: (-n[i], i))
    delta = {}
    for k, i in enumerate(order):
        d = [math.dist(points[i], points[j]) for j in order[:k]]
        d = [x for x in d if x <= 3 * gk]
        delta[i] = min(d) if d else 5 * gk
    rest = [delta[i] for i in order[1:]]
    if points:
        delta[order[0]] = max(rest) if rest else 5 * gk
    return {i: (n[i], round(delta[i], 6)) for i in delta}


@pytest.mark.parametrize("seed", [0, 1])
def test_density_peaks(spark, seed):
    rng = random.Random(seed)
    points = [(rng.gauss(rng.choice([0, 150, 400]), 30), rng.gauss(rng.choice([0, 200]), 20)) for _ in range(120)] + [(1.0, 1.0)] * 3
    found = {r.id: (r.rho, round(r.delta, 6)) for r in spatial.density_peaks(frame(spark, points)).collect()}
    assert found == peaks(points)


def test_one_point_and_none(spark):
    assert [(r.rho, r.delta) for r in spatial.density_peaks(frame(spark, [(1, 2)])).collect()] == [(1, 175.0)]
    assert spatial.density_peaks(frame(spark, [])).count() == 0


def brute_links(points, ids, link):
    label = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in ids:
                if math.dist(points[i], points[j]) <= link:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_density_labels(spark):
    rng = random.Random(3)
    points = [(rng.gauss(0, 6), rng.gauss(0, 6)) for _ in range(30)] + [(300 + rng.gauss(0, 3), rng.gauss(0, 3)) for _ in range(12)] + [(900.0, 900.0), (600.0, 0.0)]
    dense = [i for i in range(len(points)) if sum(math.dist(points[i], q) <= 50 for q in points) > 5]
    want = {i: -1 for i in range(len(points))} | brute_links(points, dense, 5.0)
    labels = spatial.density_labels(frame(spark, points))
    assert {r.id: r.label for r in labels.collect()} == want
    means = {r.label: r.n for r in spatial.label_means(frame(spark, points), labels).collect()}
    assert means == {k: list(want.values()).count(k) for k in set(want.values()) - {-1}}


def test_nearest_neighbour_skips_equal_positions(spark):
    points = [(0, 0), (0, 0), (3, 0), (100, 0), (3, 0.5)]
    found = {r.id: (r.other, round(r.d, 6)) for r in spatial.nearest_neighbour(frame(spark, points)).collect()}
    assert found == {0: (2, 3.0), 1: (2, 3.0), 2: (4, 0.5), 4: (2, 0.5)}
    labels = {r.id: r.label for r in spatial.nearest_labels(frame(spark, points)).collect()}
    assert labels == {0: 0, 1: 0, 2: 0, 3: -1, 4: 0}


def test_centres_that_crowd(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.5, 0.0), (2, 0.9, 0.0), (3, 5.0, 5.0), (4, 5.2, 5.0)], "c long, mux double, muy double")
    assert {r.c for r in spatial.crowded_centres(rows).collect()} == {0, 1, 2}
    assert {(r.c, r.other) for r in spatial.close_centres(rows, 0.3).collect()} == {(3, 4), (4, 3)}


def test_box_query_visits_all_points_inside(spark):
    rng = random.Random(9)
    points = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(2000)]
    rows = spatial.ordered_by_cell(frame(spark, points), 10.0)
    inside = {r.id for r in rows.where("x between 20 and 40 and y between 20 and 40").collect()}
    assert inside == {i for i, (x, y) in enumerate(points) if 20 <= x <= 40 and 20 <= y <= 40}


def test_kmeans_and_grid_search_agree(spark):
    rng = random.Random(4)
    points = [(rng.gauss(c, 2), rng.gauss(c, 2)) for c in (0, 20) for _ in range(20)]
    seeds = spark.createDataFrame([(0, -5.0, 0.0), (1, 30.0, 20.0), (2, 500.0, 500.0)], "c long, mux double, muy double")
    found = {r.c: r.n for r in spatial.kmeans(frame(spark, points), seeds).collect()}
    assert found == {0: 20, 1: 20, 2: 0}
    exact = {(r.id, r.c) for r in spatial.nearest_centre(frame(spark, points), seeds).collect()}
    assert {(r.id, r.c) for r in spatial.nearest_centre_grid(frame(spark, points), seeds, 60.0).collect()} == exact
