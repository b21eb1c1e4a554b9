import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixfield.operators import components as ops
from mixfield.operators import elbo, near, temporal
from mixfield.operators.storage import written
from mixfield.plans import fit, frames, registry
from mixfield.sources import generators, views
from mixfield.streaming.assign import assign, frame_counts


def brute_chain(evidence, start, moves):
    """Marginals, pair counts and evidence by summing over all state sequences."""
    n, k = evidence.shape
    total, marginals, pairs = 0.0, np.zeros((n, k)), np.zeros((k, k))
    for code in range(k**n):
        states = [code // k**t % k for t in range(n)]
        p = start[states[0]] * math.exp(evidence[0][states[0]])
        for t in range(1, n):
            p *= moves[states[t - 1]][states[t]] * math.exp(evidence[t][states[t]])
        total += p
        for t, s in enumerate(states):
            marginals[t][s] += p
            if t:
                pairs[states[t - 1]][s] += p
    return marginals / total, pairs / total, math.log(total)


def test_forward_backward_against_all_sequences():
    rng = np.random.default_rng(2)
    evidence = rng.standard_normal((5, 3)) * 3
    start = np.array([0.2, 0.3, 0.5])
    moves = rng.random((3, 3))
    moves /= moves.sum(1, keepdims=True)
    got, want = temporal.forward_backward(evidence, start, moves), brute_chain(evidence, start, moves)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1]) and abs(got[2] - want[2]) < 1e-9


def test_chains_side_by_side(spark):
    rows = [(s, t, [float(s), float(t % 2)]) for s in range(3) for t in range(4)]
    found = temporal.smooth(spark.createDataFrame(rows, "seq long, t int, logp array<double>").repartition(3), [0.5, 0.5], [[0.9, 0.1], [0.3, 0.7]]).collect()
    assert len(found) == 12
    for s in range(3):
        evidence = np.array([r[2] for r in rows if r[0] == s])
        want = temporal.forward_backward(evidence, np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.3, 0.7]]))
        own = sorted((r.t, r.p, r.log_evidence) for r in found if r.seq == s)
        assert np.allclose([p for _, p, _ in own], want[0]) and abs(own[0][2] - want[2]) < 1e-9


def test_transition_counts_of_known_traces(spark):
    # frames 3, 4, 5 are on, 6 to 8 dark, 9 on; and a component seen once, in the last frame
    traces = spark.createDataFrame([(0, f) for f in (3, 4, 5, 9, 9)] + [(1, 12)], "c long, frame int")
    found = {(r.i, r.j): r.n for r in temporal.transition_counts(traces).collect()}
    assert len(found) == 16
    assert {k: v for k, v in found.items() if v} == {(0, 0): 15, (0, 1): 2, (1, 1): 2, (1, 2): 1, (2, 1): 1, (2, 2): 2}
    bound = temporal.transition_bound(spark, temporal.transition_counts(traces), temporal.transition_prior()).first()["bound"]
    assert math.isfinite(bound)


def test_frames_include_the_last_one(spark):
    rng = random.Random(1)
    points = spark.createDataFrame([(i, i % 4, rng.gauss(0, 2), rng.gauss(0, 2), 4.0, 4.0) for i in range(40)], "id long, frame int, x double, y double, s2x double, s2y double")
    centres = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0), (1, 500.0, 0.0, 1.0, 1.0)], "c long, mux double, muy double, vx double, vy double")
    weights = spark.createDataFrame([(0, 5.0), (1, 2.0)], "c long, alpha double")
    resp = temporal.frame_estep(points, centres, weights, F.lit(-20.0)).cache()
    assert {r.frame for r in resp.where("c = 0").select("frame").distinct().collect()} == {0, 1, 2, 3}
    assert resp.where("c = 1").count() == 0
    acc = temporal.frame_accumulators(resp, weights)
    assert {(r.nt, r.xi_t) for r in acc.collect()} == {(1, 5.0)}
    assert abs(acc.agg(F.sum(F.col("acc_0") + F.col("acc_n0"))).first()[0] - 40) < 1e-9
    assert abs(temporal.centre_frame_weight(resp, acc).first()["rk2"] - 4 / 5) < 1e-12
    assert math.isfinite(temporal.frame_share_bound(weights, 1.0).first()["bound"])


def test_stream_is_assigned_like_a_table(spark, tmp_path):
    rows = spark.range(30).select("id", (F.col("id") % 3 * 50.0).alias("x"), F.lit(0.0).alias("y"), F.lit(4.0).alias("s2x"), F.lit(4.0).alias("s2y"), F.timestamp_seconds(F.col("id") * 600).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    centres = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0, -1.0), (1, 50.0, 0.0, 1.0, 1.0, -1.0)], "c long, mux double, muy double, vx double, vy double, log_weight double")
    table = {(r.id, r.c, round(r.r, 9)) for r in assign(rows, centres, F.lit(-12.0)).collect()}
    assert {(i, c) for i, c, _ in table} == {(i, (0, 1, -1)[i % 3]) for i in range(30)}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = assign(stream, centres, F.lit(-12.0)).writeStream.format("memory").queryName("assigned").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.id, r.c, round(r.r, 9)) for r in spark.table("assigned").collect()} == table
    assert sum(r.n for r in frame_counts(assign(rows, centres, F.lit(-12.0)), "ts").collect()) == 30


def test_chains_of_events_over_the_end_of_a_month(spark, tmp_path):
    from mixfield.plans import registry

    stamps = ["2024-01-30 22:10:00", "2024-01-31 05:00:00", "2024-01-31 05:20:00", "2024-02-01 22:59:59"]
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(stamps)], "event_id long, user_id long, t string")
    rows.selectExpr("event_id", "user_id", "cast(t as timestamp) AS ts", "1.0D AS value", """'{"k": 1}' AS props""").write.parquet(str(tmp_path / "events.parquet"))
    found = sorted(registry.QUERIES["forward_backward"](spark, str(tmp_path)).collect(), key=lambda r: r.t)
    assert [r.t for r in found] == list(range(49))
    n = np.zeros(49)
    n[[0, 7, 48]] = 1, 2, 1
    logp = np.stack([n * np.log(0.05) - 0.05, n * np.log(1.0) - 1.0], axis=1)
    want = smooth_by_hand(logp, np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.2, 0.8]]))
    assert np.allclose([r.p_on for r in found], want[:, 1], atol=1e-5)


def smooth_by_hand(logp, start, moves):
    p = np.exp(logp)
    ahead, back = [start * p[0]], [np.ones(2)]
    for row in p[1:]:
        ahead.append(ahead[-1] @ moves * row)
    for row in p[:0:-1]:
        back.append(moves @ (row * back[-1]))
    both = np.array(ahead) * np.array(back[::-1])
    return both / both.sum(axis=1, keepdims=True)


def framed(spark, **config):
    points = generators.gaussian_grid(spark, 2, 25, pitch=60.0, s2=30.0, seed=3).withColumn("frame", (F.col("id") % 7).cast("int"))
    points = written(generators.with_noise(points, 0.2, 4).drop("truth"), "points")
    return frames.start(points, views.cell_centres(points, pitch=60.0), fit.Config(prune=False, **config))


TERMS = ("e_noise", "e_share", "e_ent", "e_obs")


@pytest.mark.parametrize("config", [{}, {"infer_pi1": False}])
def test_gaps_of_frames_are_changes_of_the_bound(spark, config):
    """Each gap against the bounds of two whole configurations with the weights that the move gives."""
    start = framed(spark, **config)
    resp = written(start.responsibilities(), "resp")
    model, _ = frames.global_step(start, resp)
    assert abs(model.components.agg(F.sum("rk")).first()[0] + resp.where("c = -1").agg(F.sum("r")).first()[0] - start.points.count()) < 1e-6
    terms = lambda m, r: np.array([frames.bound(elbo.resp_sums(r), m).first()[n] for n in TERMS])
    before = terms(model, resp)
    alphas = [r.alpha for r in model.components.orderBy("c").collect()]
    n = len(alphas)

    def check(row, resp_after, weights):
        columns = model.components.columns
        some = model.components.drop("c", "alpha").limit(1)
        changed = spark.createDataFrame(list(enumerate(map(float, weights))), "c long, alpha double").join(some, how="cross").select(*columns)
        after, _ = frames.global_step(replace(model, components=changed), written(resp_after, "after"))
        np.testing.assert_allclose([row.noise, row.stick, row.entropy, row.obs], terms(after, resp_after) - before, atol=1e-5)

    check(frames.gap_delete(model, resp, 1).first(), ops.remove(resp, [1]), [a for k, a in enumerate(alphas) if k != 1])
    merged = alphas[0] + alphas[2] - 10.0 / n
    check(frames.gap_merge(model, resp, 0, 2).first(), ops.merge(resp, 0, 2), [merged, *alphas[1:2], *alphas[3:]])
    chosen = written(resp.where("c = -1 and x > 20"), "chosen")
    check(frames.gap_birth(model, chosen).first(), ops.insert_from_noise(resp, chosen), [1 + chosen.agg(F.sum("r")).first()[0], *alphas])
    proposed = written(resp.where("c = 1").withColumn("r1", F.col("r") * F.when(F.col("x") > 0, 0.9).otherwise(0.2)).withColumn("r2", F.col("r") - F.col("r1")), "proposed")
    mass = proposed.agg(F.sum("r1"), F.sum("r2")).first()
    whole = alphas[1] + 10.0 / (n + 1)
    halves = [whole * mass[0] / sum(mass), whole * mass[1] / sum(mass)]
    check(frames.gap_split(model, proposed, 1).first(), ops.split(resp, 1, proposed), [alphas[0], *halves, *alphas[2:]])


def test_fit_of_frames(spark):
    model = framed(spark)
    found = frames.fit(replace(model, config=fit.Config(iterations=6, tolerance=1e-6)))
    trace = [h["elbo"] for h in found.history if h["what"] == "update"]
    assert len(trace) > 1 and found.elbo >= trace[0]
    centres = found.components.toPandas()
    assert all(np.hypot(centres.mux - x, centres.muy - y).min() < 5 for x in (0, 60) for y in (0, 60))
    assert math.isfinite(frames.transition_bound(found)) and found.transitions.count() == len(temporal.transition_prior())


def test_traces_leave_a_row_for_a_component_and_frame(spark, monkeypatch):
    model = frames.step(framed(spark))
    want = {(r.c, r.frame) for r in model.responsibilities().where("c <> -1 and r > 0.4").select("c", "frame").distinct().collect()}
    monkeypatch.setattr(frames.FrameModel, "present", None)  # no row for a point and a component
    found = [(r.c, r.frame) for r in frames.traces(model).collect()]
    assert want and len(found) == len(set(found)) and set(found) == want
    assert {(r.i, r.j): r.alpha for r in frames.with_transitions(model, 50).transitions.collect()}[0, 1] > 1


def test_pairs_of_frames_against_the_joined_step(spark, monkeypatch):
    model = framed(spark)
    rows = model.points.unionByName(spark.createDataFrame([(-100_001, None, 1.0, 1.0), (-100_002, 3, None, 1.0)], "id long, frame int, x double, y double").withColumns({"s2x": F.lit(30.0), "s2y": F.lit(30.0)}), True)
    there = model.sent()
    found = {(r.id, r.frame, r.c): (r.logp, r.r) for r in near.frame_pairs(rows.repartition(3), there).collect()}
    want = {(r.id, r.frame, r.c): (r.logp, r.r) for r in model.responsibilities().collect()}
    assert found.pop((-100_001, None, -1)) == (there.everywhere.logit, 1.0) and found.pop((-100_002, 3, -1)) == (there.everywhere.logit, 1.0)
    assert all(found.pop(k) == (None, None) for k in list(found) if k[0] < -100_000)
    assert found.keys() == want.keys() and np.allclose([found[k] for k in sorted(want)], [want[k] for k in sorted(want)])
    assert near.rounded(np.array([-0.25, 0.25, 1.04]), 1).tolist() == [-0.3, 0.3, 1.0]
    # as many components in a frame as there are: none is packed into a row
    monkeypatch.setattr(temporal, "MAX_PACKED", 1)
    assert registry.QUERIES["frame_estep"](spark, "/root/testdata/sf0.001").count() == 2745


def test_moves_of_frames_raise_the_bound(spark):
    model = frames.step(framed(spark))
    for move in (lambda m: frames.delete(m, 0), lambda m: frames.merge(m, 0, 1), lambda m: frames.birth(m, m.points.where("x > 30").select("id"))):
        after = move(model)
        n, what = after.components.count(), after.history[-1]["what"]
        assert after is model or (what != "update" and n == model.components.count() + {"dead": -1, "merge": -1, "birth": 1}[what])


def test_parameters_of_frames(spark):
    """Log weights by frame, and only components within some standard deviations."""
    points = spark.createDataFrame([(0, 0, 0.0, 0.0, 4.0, 4.0), (1, 1, 9.0, 0.0, 4.0, 4.0)], "id long, frame int, x double, y double, s2x double, s2y double")
    centres = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0)], "c long, mux double, muy double, vx double, vy double")
    weights = spark.createDataFrame([(0, 3.0)], "c long, alpha double")
    values = spark.createDataFrame([(1, -5.0, 2.0)], "frame int, value0 double, value1 double")
    plain = {(r.id, r.c): r.logp for r in temporal.frame_estep(points, centres, weights, F.lit(-20.0)).collect()}
    with_values = {(r.id, r.c): r.logp for r in temporal.frame_estep(points, centres, weights, F.lit(-20.0), values=values).collect()}
    assert with_values[0, -1] == -20.0 and with_values[1, -1] == -5.0
    assert with_values[0, 0] == plain[0, 0] and abs(with_values[1, 0] - plain[1, 0] - 2.0) < 1e-12
    near = {(r.id, r.c) for r in temporal.frame_estep(points, centres, weights, F.lit(-20.0), sigmas=4.0).collect()}
    assert near == {(0, -1), (0, 0), (1, -1)}


def test_average_trace_against_forward_backward(spark):
    prior = [(0, 0, 10.0), (0, 1, 11.0), (1, 1, 30.0), (1, 2, 12.0), (1, 3, 11.0), (2, 1, 9.0), (2, 2, 40.0), (2, 3, 1.0), (3, 3, 1.0)]
    pairs, evidence = temporal.average_trace(spark, spark.createDataFrame(prior, "i int, j int, alpha double"), 0.2, steps=50)
    from twin import digamma

    moves = np.zeros((3, 3))
    for i, j, a in prior:
        if i and j:
            moves[i - 1, j - 1] = math.exp(digamma(np.array(a)) - digamma(np.array(sum(w for k, _, w in prior if k == i))))
    ahead = [np.array([math.exp(-0.2), 0.0, 0.0])]
    for _ in range(49):
        ahead.append(ahead[-1] @ moves * np.exp([-0.2, -1e-10, -1e-10]))
    assert abs(evidence - math.log(ahead[-1].sum())) < 1e-7
    assert abs(np.sum(pairs) - 49) < 1e-6
