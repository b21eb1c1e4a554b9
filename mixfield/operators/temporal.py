"""Operators on frames: which components are active when, their transitions, and forward-backward smoothing."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixfield.functions.special import c_dirichlet, c_gamma, digamma
from mixfield.operators.estep import NOISE, log_density, log_sum, normalized, point_columns
from mixfield.operators.spatial import MAX_PACKED, XY, range_join
from mixfield.operators.order import numbered
from mixfield.operators.storage import written

STATES = 4  # not yet active, on, dark, bleached


def active_centres(points: DataFrame, components: DataFrame, radius: float = 30.0, axes=XY) -> DataFrame:
    """``frame, c``: the components within ``radius`` of any point of a frame."""
    centres = components.select("c", *(F.col(f"mu{a}").alias(a) for a in axes))
    return range_join(points.select("frame", *axes), centres, radius, axes).select(F.col("l_frame").alias("frame"), F.col("r_c").alias("c")).distinct()


def frame_weights(active: DataFrame, weights: DataFrame) -> DataFrame:
    """``frame, c, log_weight``: the expected log share of each active component under Dirichlet weights ``weights(c, alpha)``."""
    rows = active.join(weights, "c")
    sums = rows.groupBy("frame").agg(F.sum("alpha").alias("total"))
    return rows.join(sums, "frame").select("frame", "c", (digamma(F.col("alpha")) - digamma(F.col("total"))).alias("log_weight"))


def frame_tables(points: DataFrame, components: DataFrame, weights: DataFrame | None = None, radius: float = 30.0, axes=XY) -> DataFrame:
    """``frame, ks, nt, xi_t``: the components active in a frame as one array with their log weights, their number and the sum of their weights.

    Without ``weights(c, alpha)`` the components have a column ``alpha``. An array has a row's size for each component that a frame's points come near, MAX_PACKED at most: more in
    one frame are an error.
    """
    if weights is not None:
        components = components.drop("alpha").join(weights.select("c", "alpha"), "c")
    own = [f"v{a}" for a in axes] + ["alpha", "log_alpha"]
    rows = components.select("c", *(F.col(f"mu{a}").alias(a) for a in axes), *(f"v{a}" for a in axes), "alpha", digamma(F.col("alpha")).alias("log_alpha"))
    near = range_join(points.select("frame", *axes), rows, radius, axes)
    # each component once for a frame, with what it needs
    active = near.groupBy(F.col("l_frame").alias("frame"), F.col("r_c").alias("c")).agg(*(F.first(f"r_{a}").alias(f"mu{a}") for a in axes), *(F.first(f"r_{x}").alias(x) for x in own))
    tables = active.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("c", *(f"mu{a}" for a in axes), *own))).alias("ks"), F.count("*").alias("nt"), F.sum("alpha").alias("xi_t"))
    tables = tables.withColumn("log_total", digamma(F.col("xi_t")))
    columns = ["c", *(f"mu{a}" for a in axes), *(f"v{a}" for a in axes)]
    named = F.transform("ks", lambda k: F.struct(*(k[x].alias(x) for x in columns), (k["log_alpha"] - F.col("log_total")).alias("log_weight")))
    checked = F.when(F.col("nt") <= MAX_PACKED, named).otherwise(F.raise_error(F.lit(f"more than {MAX_PACKED} components in a frame")))
    return tables.select("frame", checked.alias("ks"), "nt", "xi_t")


def frame_sums(points: DataFrame, components: DataFrame, weights: DataFrame, logit: Column, radius: float = 30.0, axes=XY) -> DataFrame:
    """``frame_accumulators`` of ``frame_estep`` without a row for each point and component: a point adds its noise and its rest to its frame."""
    tables = frame_tables(points, components, weights, radius, axes)
    rows = points.select("frame", *axes, *(f"s2{a}" for a in axes)).join(tables, "frame", "left")
    logs = F.transform(F.coalesce("ks", F.array()), lambda k: log_density(k, axes))
    noise = F.exp(logit - log_sum(F.concat(F.array(logit.cast("double")), logs)))
    rows = rows.select("frame", noise.alias("noise"), "nt", "xi_t")
    return rows.groupBy("frame").agg(F.sum("noise").alias("acc_0"), F.sum(1.0 - F.col("noise")).alias("acc_n0"), F.coalesce(F.first("nt"), F.lit(0)).alias("nt"), F.coalesce(F.first("xi_t"), F.lit(0.0)).alias("xi_t"))


def frame_estep(points: DataFrame, components: DataFrame, weights: DataFrame, logit: Column, radius: float = 30.0, axes=XY, sigmas: float | None = None, values: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, frame, c, logp, r`` and the point's columns: each point against noise and the components active in its frame.

    With ``sigmas`` only those within so many root mean variances of the point count. ``values(frame, value0, value1)`` has a log weight of noise, in
    place of ``logit``, and an offset of the components' log weights for each frame; a frame that it lacks has ``logit`` and 0. The components of a frame
    come to its points as one array (see ``frame_tables``), and a point's weights are normalized in its row. Columns ``keep`` of the points stay.
    """
    own = ["frame", *point_columns(axes), *keep]
    rows = points.select(*own).join(frame_tables(points, components, weights, radius, axes).select("frame", "ks"), "frame", "left")
    ks = F.coalesce("ks", F.array())
    if sigmas is not None:
        mean = reduce(lambda a, b: a + b, [F.col(f"s2{a}") for a in axes]) / len(axes)
        ks = F.filter(ks, lambda k: reduce(lambda a, b: a + b, [(F.col(a) - k[f"mu{a}"]) ** 2 for a in axes]) < sigmas * sigmas * mean)
    if values is not None:
        rows = rows.join(values.select("frame", "value0", "value1"), "frame", "left")
        logit = F.coalesce("value0", logit)
        ks = F.transform(ks, lambda k: k.withField("log_weight", k["log_weight"] + F.coalesce("value1", F.lit(0.0))))
    return normalized(rows, own, ks, logit, axes)


def frame_accumulators(resp: DataFrame, weights: DataFrame) -> DataFrame:
    """``frame, acc_0, acc_n0, nt, xi_t``: noise and other mass, number of components seen and sum of their weights ``gamma``."""
    noise = F.col("c") == NOISE
    sums = resp.groupBy("frame").agg(F.sum(F.when(noise, F.col("r")).otherwise(0.0)).alias("acc_0"), F.sum(F.when(noise, 0.0).otherwise(F.col("r"))).alias("acc_n0"))
    seen = resp.where(~noise).select("frame", "c").distinct().join(weights.select("c", F.col("alpha").alias("gamma")), "c")
    return sums.join(seen.groupBy("frame").agg(F.count("*").alias("nt"), F.sum("gamma").alias("xi_t")), "frame", "left").na.fill({"nt": 0, "xi_t": 0.0})


def centre_frame_weight(resp: DataFrame, accumulators: DataFrame) -> DataFrame:
    """``c, rk2``: the sum of ``1 / xi_t`` over the frames in which a component was seen."""
    seen = resp.where(F.col("c") != NOISE).select("frame", "c").distinct()
    return seen.join(accumulators.where("xi_t > 0"), "frame").groupBy("c").agg(F.sum(1.0 / F.col("xi_t")).alias("rk2"))


def centre_weights(tables: DataFrame) -> DataFrame:
    """``centre_frame_weight`` from ``frame_tables``."""
    return tables.where("xi_t > 0").select(F.explode("ks.c").alias("c"), "xi_t").groupBy("c").agg(F.sum(1.0 / F.col("xi_t")).alias("rk2"))


def frame_entropy(resp: DataFrame, least: float = 1e-10) -> DataFrame:
    """``frame, entropy``: sum of r ln r over components, without noise and tiny values."""
    return resp.where((F.col("c") != NOISE) & (F.col("r") > least)).groupBy("frame").agg(F.sum(F.col("r") * F.ln("r")).alias("entropy"))


def transition_counts(traces: DataFrame) -> DataFrame:
    """``i, j, n`` of the four states, summed over components, for ``traces(c, frame)`` with the frames in which each is seen.

    A component waits until its first frame, goes on from frame to frame where the next one follows, and is dark over gaps; a gap of g frames
    gives one step into the dark, g - 2 within it and one out of it. All cells of the 4 by 4 table are returned.
    """
    frames = traces.select("c", "frame").distinct()
    gaps = frames.withColumn("gap", F.col("frame") - F.lag("frame").over(Window.partitionBy("c").orderBy("frame")))
    own = gaps.groupBy("c").agg(
        F.min("frame").alias("first"),
        F.sum(F.when(F.col("gap") == 1, 1).otherwise(0)).alias("on"),
        F.sum(F.when(F.col("gap") > 1, 1).otherwise(0)).alias("dark"),
        F.sum(F.when(F.col("gap") > 1, F.col("gap") - 2).otherwise(0)).alias("stay"),
    )
    total = own.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("first", "on", "dark", "stay")), F.count("*").alias("n"))
    known = {(0, 0): "first", (0, 1): "n", (1, 1): "on", (1, 2): "dark", (2, 1): "dark", (2, 2): "stay"}
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(known[i, j]) if (i, j) in known else F.lit(0)).cast("long").alias("n")) for i in range(STATES) for j in range(STATES)]
    return total.select(F.explode(F.array(*cells)).alias("k")).select("k.*")


def transition_prior(weight: float = 1.0) -> list[tuple[int, int, float]]:
    """The allowed transitions: a state never comes back to waiting, and bleaching is final."""
    allowed = {0: (0, 1), 1: (1, 2, 3), 2: (1, 2, 3), 3: (3,)}
    return [(i, j, weight) for i, to in allowed.items() for j in to]


def transition_bound(spark, counts: DataFrame, prior: list[tuple[int, int, float]]) -> DataFrame:
    """``bound``: the change of the log normalizers of the rows of transitions from prior to posterior.

    The constant of ``trace_counts`` times the number of components comes on top.
    """
    rows = spark.createDataFrame(prior, "i int, j int, prior double").join(counts.select("i", "j", "n"), ["i", "j"], "left").na.fill(0)
    by_row = rows.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "prior", (F.col("prior") + F.col("n")).alias("post")))).alias("cells"))
    parts = []
    for n in (1, 2, 3):
        before, after = ([F.col("cells")[k][name] for k in range(n)] for name in ("prior", "post"))
        parts.append(F.when(F.size("cells") == n, c_dirichlet(before) - c_dirichlet(after)))
    return by_row.agg(F.sum(F.coalesce(*parts)).alias("bound"))


def frame_share_bound(weights: DataFrame, alpha0: float) -> DataFrame:
    """``bound``: the part of the components' weights in the bound of the model with frames."""
    return weights.agg(F.coalesce(F.sum(c_gamma(F.lit(float(alpha0)), F.lit(1.0)) - c_gamma(F.col("alpha"), F.lit(1.0))), F.lit(0.0)).alias("bound"))


#: Transitions that are counted before anything is seen.
FIRST_COUNTS = {(0, 1): 10.0, (1, 2): 10.0, (1, 3): 10.0}


def first_counts(traces: DataFrame, least: int = 10) -> DataFrame:
    """``i, j, n``: the transitions of the first ``least`` components of ``traces(c, frame)`` and FIRST_COUNTS."""
    few = traces.select("c").distinct().orderBy("c").limit(least)
    seeds = F.coalesce(*(F.when((F.col("i") == i) & (F.col("j") == j), n) for (i, j), n in FIRST_COUNTS.items()), F.lit(0.0))
    return transition_counts(traces.join(few, "c", "left_semi")).withColumn("n", F.col("n") + seeds)


def average_trace(spark, posterior: DataFrame, share: float, steps: int = 10_000) -> tuple[list[list[float]], float]:
    """Summed pair probabilities of on, dark and bleached, and log evidence, of a component's trace as it decays on average.

    The chain starts on and has ``steps`` steps, whatever the data, with the expected logs of ``posterior(i, j, alpha)`` as transitions and ``share``, the mean
    share of a component, as what an on state costs in a frame without a point.
    """
    totals = posterior.groupBy("i").agg(F.sum("alpha").alias("total"))
    logs = posterior.join(totals, "i").where("i > 0 and j > 0").select("i", "j", F.when(F.col("alpha") > 0, F.exp(digamma(F.col("alpha")) - digamma(F.col("total")))).otherwise(0.0).alias("p"))
    moves = [[0.0] * (STATES - 1) for _ in range(STATES - 1)]
    for r in logs.collect():  # nine rows
        moves[r["i"] - 1][r["j"] - 1] = r["p"]
    step, cost = np.array(moves), np.array([-share, -1e-10, -1e-10])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        _, pairs, evidence = forward_backward(np.tile(cost, (steps, 1)), np.array([1.0, 0.0, 0.0]), step)
        return pd.DataFrame({"pairs": [pairs.ravel().tolist()], "evidence": [evidence]})

    row = spark.range(1).groupBy("id").applyInPandas(run, "pairs array<double>, evidence double").first()
    return np.array(row["pairs"]).reshape(3, 3).tolist(), float(row["evidence"])


def trace_counts(traces: DataFrame, posterior: DataFrame, weights: DataFrame, steps: int = 10_000) -> tuple[DataFrame, float]:
    """``i, j, n`` and the constant of the transitions: what is seen in ``traces(c, frame)``, and for each component the average decay.

    ``weights(c, alpha)`` give the mean share. Bleaching is final, so its stays aren't counted.
    """
    spark = traces.sparkSession
    sums = weights.agg(F.count("*").alias("n"), F.avg("alpha").alias("mean"), F.sum("alpha").alias("total")).first()
    if not sums["n"]:
        return transition_counts(traces), 0.0
    pairs, evidence = average_trace(spark, posterior, sums["mean"] / sums["total"], steps)
    decay = [(i + 1, j + 1, pairs[i][j] * sums["n"]) for i in range(3) for j in range(3) if (i, j) != (2, 2)]
    seen = transition_counts(traces).withColumn("n", F.when((F.col("i") == 0) & (F.col("j") == 1), F.lit(0.0)).otherwise(F.col("n")))
    more = spark.createDataFrame([*decay, (0, 1, float(sums["n"]))], "i int, j int, n double")
    return seen.unionByName(more).groupBy("i", "j").agg(F.sum("n").alias("n")), evidence


def forward_backward(evidence: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (T, K), summed pair probabilities (K, K) and log evidence of a chain with log evidence (T, K)."""
    top = evidence.max(axis=1)
    soft = np.exp(evidence - top[:, None])
    n, k = soft.shape
    ahead, scale = np.empty((n, k)), np.empty(n)
    for t in range(n):
        now = (start if t == 0 else ahead[t - 1] @ moves) * soft[t]
        scale[t] = now.sum()
        ahead[t] = now / scale[t]
    back, marginals, pairs = np.ones(k), np.empty((n, k)), np.zeros((k, k))
    for t in range(n - 1, -1, -1):
        marginals[t] = ahead[t] * back
        if t:
            after = soft[t] * back / scale[t]
            pairs += ahead[t - 1][:, None] * moves * after[None, :]
            back = moves @ after
    return marginals, pairs, float(np.log(scale).sum() + top.sum())


#: A chain is cut into blocks of so many steps.
CHAIN_BLOCK = 4096


#: Steps that a task smooths together, as blocks side by side.
STEPS_AT_ONCE = 1 << 18


def _side_by_side(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in order, of which those of a sequence have the same ``key``: the starts of sequences and their lengths, longest first, and for each place in them how many are longer."""
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(key) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(key)))
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order], np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)))


def _block_products(soft: np.ndarray, starts: np.ndarray, longer: np.ndarray, moves: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block the product of its steps as a matrix of largest entry 1, and the log of its scale; the first step of a chain has no move before it."""
    product, scale = np.tile(np.eye(len(moves)), (len(starts), 1, 1)), np.zeros(len(starts))
    for t, m in enumerate(longer.tolist()):
        now = product[:m] @ moves
        if t == 0:
            now[opens] = product[opens]
        now = now * soft[starts[:m] + t][:, None, :]
        most = now.max(axis=(1, 2))
        product[:m] = now / most[:, None, None]
        scale[:m] += np.log(most)
    return product, scale


def _scans(products: np.ndarray, starts: np.ndarray, longer: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block what comes before it in its chain and what follows, up to a factor, and for each chain the log of what the factors are."""
    before, after = np.empty(products.shape[:2]), np.empty(products.shape[:2])
    ahead, back, evidence = np.tile(start, (len(starts), 1)), np.ones((len(starts), len(start))), np.zeros(len(starts))
    for t, m in enumerate(longer.tolist()):
        at = starts[:m] + t
        before[at] = ahead[:m]
        now = (ahead[:m, None, :] @ products[at])[:, 0]
        total = now.sum(axis=1)
        ahead[:m] = now / total[:, None]
        evidence[:m] += np.log(total)
    for t, m in reversed(list(enumerate(longer.tolist()))):
        at = starts[:m] + t
        after[at] = back[:m]
        now = (products[at] @ back[:m, :, None])[:, :, 0]
        back[:m] = now / now.max(axis=1)[:, None]
    return before, after, evidence


def _values(rows: pa.Table, name: str) -> np.ndarray:
    """A column of lists of the same length, a row for each."""
    return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _lists(values: np.ndarray) -> pa.Array:
    values = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.ravel())


def smooth(sequences: DataFrame, start: list[float], moves: list[list[float]], block: int = CHAIN_BLOCK) -> DataFrame:
    """``seq, t, p, log_evidence`` for ``sequences(seq, t, logp array<double>)``: the marginals of each chain, however long it is.

    The steps of a block of ``block`` places are multiplied to one matrix, which is associative: so blocks run side by side, and a chain's recursion goes over its blocks' matrices, forward and
    backward. Then each block is smoothed by itself from what comes before it and what follows. Of a chain only these matrices meet in a task. A task takes a step of many blocks at once, so short
    chains are no groups of their own. Steps are in order of ``t``; no step is left out where ``t`` has gaps. A ``t`` that occurs twice in a chain is two steps in no fixed order.
    """
    first, step = np.array(start, float), np.array(moves, float)
    kinds = dict(sequences.dtypes)
    seq, t = kinds["seq"], kinds["t"]
    # places within chains, by ranges
    rows = written(numbered(sequences.select("seq", "t", "logp"), "_at", "seq", "t"), "steps")
    groups = rows.count() // STEPS_AT_ONCE + 1
    begins = rows.groupBy("seq").agg(F.min("_at").alias("_begin"))
    rows = rows.join(begins, "seq").withColumn("_block", F.expr(f"(_at - _begin) div {block}"))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_begin", "_block"), F.lit(groups)))

    def blocks(part: pa.Table) -> tuple:
        part = part.sort_by("_at")
        return part, *_side_by_side(np.stack([part.column(n).to_numpy() for n in ("_begin", "_block")], axis=1))

    def multiply(part: pa.Table) -> pa.Table:
        part, starts, _, longer = blocks(part)
        evidence = _values(part, "logp")
        top = evidence.max(axis=1)
        number = part.column("_block").to_numpy()[starts]
        product, scale = _block_products(np.exp(evidence - top[:, None]), starts, longer, step, np.flatnonzero(number == 0))
        whole = np.append(0.0, np.cumsum(top))
        ends = np.append(np.sort(starts), len(part))[np.searchsorted(np.sort(starts), starts) + 1]
        return pa.table([pa.array(part.column("_begin").to_numpy()[starts]), pa.array(number), _lists(product), pa.array(scale + whole[ends] - whole[starts])], ["_begin", "_block", "product", "scale"])

    def scan(part: pa.Table) -> pa.Table:
        part = part.sort_by([("_begin", "ascending"), ("_block", "ascending")])
        starts, lengths, longer = _side_by_side(part.column("_begin").to_numpy()[:, None])
        before, after, evidence = _scans(_values(part, "product").reshape(-1, len(first), len(first)), starts, longer, first)
        own = np.empty(len(part), np.int64)
        own[np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)] = np.repeat(np.arange(len(starts)), lengths)
        evidence = evidence + np.bincount(own, part.column("scale").to_numpy(), len(starts))
        return pa.table([part.column("_begin"), part.column("_block"), _lists(before), _lists(after), pa.array(evidence[own])], ["_begin", "_block", "before", "after", "log_evidence"])

    def within(part: pa.Table) -> pa.Table:
        part, starts, _, longer = blocks(part)
        evidence = _values(part, "logp")
        soft = np.exp(evidence - evidence.max(axis=1)[:, None])
        p = _smoothed(soft, starts, longer, _values(part, "before")[starts], _values(part, "after")[starts], step, np.flatnonzero(part.column("_block").to_numpy()[starts] == 0))
        return pa.table([part.column("seq"), part.column("t"), _lists(p), part.column("log_evidence")], ["seq", "t", "p", "log_evidence"])

    products = rows.groupBy("_group").applyInArrow(multiply, "_begin long, _block long, product array<double>, scale double")
    chains = F.pmod(F.xxhash64("_begin"), F.lit(groups))
    ends = written(products.groupBy(chains.alias("_group")).applyInArrow(scan, "_begin long, _block long, before array<double>, after array<double>, log_evidence double"), "ends")
    return rows.join(ends, ["_begin", "_block"]).groupBy("_group").applyInArrow(within, f"seq {seq}, t {t}, p array<double>, log_evidence double")


def _smoothed(soft: np.ndarray, starts: np.ndarray, longer: np.ndarray, before: np.ndarray, after: np.ndarray, moves: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The marginals of the steps of blocks."""
    ahead, out = np.empty(soft.shape), np.empty(soft.shape)
    for t, m in enumerate(longer.tolist()):
        at = starts[:m] + t
        now = before[:m] @ moves
        if t == 0:
            now[opens] = before[opens]
        now = now * soft[at]
        ahead[at] = before[:m] = now / now.sum(axis=1)[:, None]
    back = after.copy()
    for t, m in reversed(list(enumerate(longer.tolist()))):
        at = starts[:m] + t
        both = ahead[at] * back[:m]
        out[at] = both / both.sum(axis=1)[:, None]
        now = (soft[at] * back[:m]) @ moves.T
        back[:m] = now / now.max(axis=1)[:, None]
    return out
