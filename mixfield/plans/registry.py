"""All registered queries of the clustering engine with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from mixfield.operators import elbo, estep, metrics, mstep, near, spatial, temporal
from mixfield.operators import components as surgery
from mixfield.operators.storage import written
from mixfield.plans import fit, frames, oracle as o
from mixfield.sources import generators, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return views.event_points(spark, folder)


def _table(spark: SparkSession, folder: str) -> DataFrame:
    """``_points`` as a table, for queries that read them more than once."""
    return written(_points(spark, folder), "points")


FIXED = fit.Config(prune=False, infer_pi1=False, infer_alpha0=False)


def _setup(spark: SparkSession, folder: str, config: fit.Config = fit.Config(prune=False)) -> fit.Model:
    """Points of events with the cells' centres as components."""
    points = _table(spark, folder)
    return fit.start(points, views.cell_centres(points), config)


def _one_step(spark: SparkSession, folder: str, config: fit.Config = fit.Config(prune=False)) -> fit.Model:
    return fit.step(_setup(spark, folder, config))


# Priors, local and global step

@query(o.with_(o.PTS, o.PRIOR) + f"SELECT n, {o.rounded(3, 'area', 'mu0x', 'mu0y', 'mean_sigma', 'logp0')}, round(sigma02 / 1e6, 3) AS sigma02 FROM prior")
def prior_scalars(spark, folder):
    rows = views.prior_scalars(_points(spark, folder)).withColumn("sigma02", F.col("sigma02") / 1e6)
    return rounded(rows, 3, "area", "mu0x", "mu0y", "mean_sigma", "logp0", "sigma02")


@query(o.with_(*o.BASE) + f"SELECT id, c, round({o.LOGN}, 3) AS logp FROM pts, cen")
def gauss_loglik(spark, folder):
    points = _table(spark, folder)
    found = estep.log_likelihood(points, written(views.cell_centres(points), "centres"))
    return found.withColumn("logp", estep.rounded(F.col("logp"), 3))


@query(o.with_(*o.BASE, o.estep(0)) + "SELECT id, c, round(logp, 3) AS logp, round(r, 4) AS r FROM r0")
def estep_exact(spark, folder):
    pairs = _setup(spark, folder).every_pair()
    return pairs.select("id", "c", estep.rounded(F.col("logp"), 3).alias("logp"), estep.rounded(F.col("r"), 4).alias("r"))


SPARSE = o.with_(*o.BASE, o.estep(0, "WHERE pow(x - mux, 2) + pow(y - muy, 2) < 16 * (s2x + s2y) / 2", True))


@query(SPARSE + "SELECT id, c, round(logp, 3) AS logp, round(r, 4) AS r FROM r0")
def estep_sparse(spark, folder):
    model = _setup(spark, folder)
    found = estep.sparse(model.points, model.components, model.logit())
    return rounded(found.select("id", "c", "logp", "r"), 4, "r").withColumn("logp", F.round("logp", 3))


@query(SPARSE.rstrip() + ",\n" + o.mstep(0) + "\nSELECT c, n, " + o.rounded(3, "rk", "xxx", "xxy", "sxx", "sxy") + " FROM st0")
def suff_stats(spark, folder):
    model = _setup(spark, folder)
    return rounded(mstep.sufficient_stats(estep.sparse(model.points, model.components, model.logit())), 3, "rk", "xxx", "xxy", "sxx", "sxy")


STEP = o.with_(*o.BASE, o.estep(0), o.mstep(0))
CS = f"SELECT c, {o.rounded(4, 'mux', 'muy', 'vx', 'vy')}, {o.rounded(3, 'rk', 'eta1', 'eta0')}, round(eu, 4) AS elog_u, round(e1, 4) AS elog_1mu, round(lw, 3) AS log_weight FROM "


def _shown(components: DataFrame) -> DataFrame:
    return rounded(rounded(components, 4, "mux", "muy", "vx", "vy", "elog_u", "elog_1mu"), 3, "rk", "eta1", "eta0", "log_weight")


@query(STEP + CS + "cs1")
def mstep_update(spark, folder):
    return _shown(_one_step(spark, folder).components)


@query(o.with_(*o.BASE) + "SELECT c, round(eta1, 3) AS eta1, round(eta0, 3) AS eta0, round(eu, 4) AS elog_u, round(e1, 4) AS elog_1mu, round(lw, 3) AS log_weight FROM cs0")
def stick_weights(spark, folder):
    return _shown(mstep.stick_weights(views.cell_centres(_points(spark, folder)))).select("c", "eta1", "eta0", "elog_u", "elog_1mu", "log_weight")


ELBO = f"SELECT {o.rounded(2, 'e_noise', 'e_obs', 'e_sb', 'e_ent')} FROM el1"


def _elbo_terms(before: fit.Model) -> DataFrame:
    stats = written(fit.local_stats(before), "stats")
    sums = elbo.stats_sums(stats)
    after = fit.step(before, stats=stats)
    return rounded(elbo.bound(sums, after.components, after.scalars, after.prior), 2, "e_noise", "e_obs", "e_sb", "e_ent").drop("elbo")


@query(STEP + ELBO)
def elbo_terms(spark, folder):
    return _elbo_terms(_setup(spark, folder))


@query(o.with_(*o.BASE, o.estep(0, fixed=True), o.mstep(0, True)) + ELBO)
def elbo_terms_fixed(spark, folder):
    return _elbo_terms(_setup(spark, folder, FIXED))


@query(o.with_(*o.BASE, *(x for i in range(3) for x in (o.estep(i), o.mstep(i)))) + CS + "cs3")
def vb_3_iterations(spark, folder):
    model = _setup(spark, folder)
    for _ in range(3):
        model = fit.step(model)
    return _shown(model.components)


# Moves. Component 5 is deleted or split, 3 and 5 are merged, and the noise left of 100 becomes a component; with the share of noise and the
# concentration inferred, and with both fixed.


def _gap_sql(parts: list[str], noise: str | None, after: tuple[str, str], rest: str, entropy: str, obs: str, source: str, fixed: bool) -> str:
    """SQL of a gap, from the moved responsibility and posterior of the share, the concentration after it, and its other terms."""
    steps = o.with_(*o.BASE, o.estep(0, fixed=fixed), o.mstep(0, fixed), o.estep(1, fixed=fixed), o.BASED)
    if fixed:
        moved, stick = "0e0", f"{o.stick_fixed(rest)} - {o.stick_fixed('cs1')}"
    else:
        moved, stick = f"({after[0]}) / ({after[1]}) - (SELECT g1 / g2 FROM sc1)", f"{o.stick(rest, *after)} - {o.stick('cs1', '(SELECT g1 FROM sc1)', '(SELECT g2 FROM sc1)')}"
    if noise:
        share = f"({noise}) * {o.LOGIT}" if fixed else f"({noise}) * logp0 - {o.c_beta(f'(a + ({noise}))', f'(b - ({noise}))')} + {o.c_beta('a', 'b')}"
    select = f"SELECT {share if noise else '0e0'} AS noise, {stick} AS stick, {entropy} AS entropy, {obs} AS obs FROM {source}"
    return steps.rstrip() + ",\n" + ",\n".join(p.replace("{DA}", moved) for p in parts) + f",\ngap AS ({select})\nSELECT {o.GAP} FROM gap"


def _centre_sql(table: str, where: str = "") -> str:
    return f"(SELECT sum({o.c_obs('mux', 'vx')} + {o.c_obs('muy', 'vy')}) FROM {table} {where})"


CO0 = f"({o.c_obs('mu0x', 'sigma02')} + {o.c_obs('mu0y', 'sigma02')})"


def _delete_sql(fixed: bool) -> str:
    return _gap_sql(
        [
            "k AS (SELECT o.*, z.r AS r0 FROM r1 o JOIN (SELECT id, r FROM r1 WHERE c = -1) z ON o.id = z.id WHERE c = 5 AND o.r > 0)",
            f"s AS (SELECT sum(r) AS m, sum(r * ({o.c_obs('x', 's2x')} + {o.c_obs('y', 's2y')})) AS co, sum(-{o.plogp('(r + r0)')} + {o.plogp('r0')} + {o.plogp('r')}) AS h FROM k)",
            o.moved("rest", "(SELECT * FROM based WHERE c <> 5)", "{DA}"),
        ],
        "m", ("(SELECT g1 - 1 FROM sc1)", "(SELECT g2 + (SELECT e1 FROM cs1 WHERE c = 5) FROM sc1)"), "rest", "h", f"-co - {CO0} + {_centre_sql('cs1', 'WHERE c = 5')}", "s, sc1, prior", fixed,
    )


def _merge_sql(fixed: bool) -> str:
    return _gap_sql(
        [
            f"k AS (SELECT id, x, y, s2x, s2y, sum(r) AS r, sum({o.plogp('r')}) AS apart FROM r1 WHERE c IN (3, 5) GROUP BY ALL)",
            o.new_centre("m", "k", "r"),
            f"s AS (SELECT sum(apart - {o.plogp('r')}) AS h FROM k)",
            o.moved("rest", "(SELECT c, base, rk + CASE WHEN c = 3 THEN (SELECT rk FROM cs1 WHERE c = 5) ELSE 0 END AS rk FROM based WHERE c <> 5)", "{DA}"),
        ],
        None, ("(SELECT g1 - 1 FROM sc1)", "(SELECT g2 + (SELECT e1 FROM cs1 WHERE c = 5) FROM sc1)"), "rest", "h", f"-{CO0} - {_centre_sql('m')} + {_centre_sql('cs1', 'WHERE c IN (3, 5)')}", "s, prior", fixed,
    )


def _birth_sql(fixed: bool) -> str:
    g1, g2 = "(SELECT 2e0 + count(*) FROM cs1)", "(SELECT 1e-2 - sum(e1) FROM cs1)"
    alpha = o.ALPHA0 if fixed else f"({g1}) / ({g2})"
    return _gap_sql(
        [
            "k AS (SELECT * FROM r1 WHERE c = -1 AND x < 100)",
            o.new_centre("m", "k", "r"),
            o.moved("old", "based", "{DA}"),
            f"rest AS (SELECT eta1, eta0 FROM old UNION ALL SELECT 1 + (SELECT rk FROM m), {alpha} + (SELECT sum(rk) FROM cs1))",
        ],
        "-rk", (g1, g2), "rest", "0e0", f"co + {CO0} - {_centre_sql('m')}", "m, sc1, prior", fixed,
    )


def _split_sql(fixed: bool) -> str:
    return _gap_sql(
        [
            "k AS (SELECT *, r * CASE WHEN x < (SELECT mux FROM cs1 WHERE c = 5) THEN 0.9e0 ELSE 0.1e0 END AS ra FROM r1 WHERE c = 5 AND r > 0)",
            o.new_centre("ma", "k", "ra"),
            o.new_centre("mb", "k", "(r - ra)"),
            f"s AS (SELECT sum({o.plogp('r')} - {o.plogp('ra')} - {o.plogp('(r - ra)')}) AS h FROM k)",
            o.moved("rest", "(SELECT CASE WHEN c > 5 THEN c + 1 ELSE c END AS c, base, CASE WHEN c = 5 THEN (SELECT rk FROM ma) ELSE rk END AS rk FROM based UNION ALL SELECT 6, base, (SELECT rk FROM mb) FROM based WHERE c = 5)", "{DA}"),
        ],
        None, ("(SELECT g1 + 1 FROM sc1)", "(SELECT 1e-2 - sum(e1) + (SELECT e1 FROM cs1 WHERE c = 5) FROM cs1)"), "rest", "h",
        f"{CO0} - {_centre_sql('ma')} - {_centre_sql('mb')} + {_centre_sql('cs1', 'WHERE c = 5')}", "s, prior", fixed,
    )


def _shown_gap(gap: DataFrame) -> DataFrame:
    return rounded(gap.drop("gap"), 2, "noise", "stick", "entropy", "obs")


def _delete_gap(m: fit.Model) -> DataFrame:
    return _shown_gap(elbo.gap_delete(m.present([5, estep.NOISE]), m.components, m.scalars, m.prior, 5))


def _merge_gap(m: fit.Model) -> DataFrame:
    return _shown_gap(elbo.gap_merge(m.present([3, 5]), m.components, m.scalars, m.prior, 3, 5))


def _birth_gap(m: fit.Model) -> DataFrame:
    candidates = written(estep.noise_points(m.present([estep.NOISE]), -1.0).where("x < 100"), "noise")
    return _shown_gap(elbo.gap_birth(candidates, m.components, m.scalars, m.prior))


def _split_gap(m: fit.Model) -> DataFrame:
    at = float(m.components.where("c = 5").first()["mux"])
    rows = m.present([5]).where("c = 5 and r > 0").withColumn("r1", F.col("r") * F.when(F.col("x") < at, 0.9).otherwise(0.1))
    proposed = written(rows.withColumn("r2", F.col("r") - F.col("r1")), "proposed")
    return _shown_gap(elbo.gap_split(proposed, m.components, m.scalars, m.prior, 5))


@query(_delete_sql(False))
def gap_delete(spark, folder):
    return _delete_gap(_one_step(spark, folder))


@query(_delete_sql(True))
def gap_delete_fixed(spark, folder):
    return _delete_gap(_one_step(spark, folder, FIXED))


@query(
    o.with_(
        *o.BASE, o.estep(0), o.mstep(0), o.estep(1),
        "k AS (SELECT o.*, z.r AS r0 FROM r1 o JOIN (SELECT id, r FROM r1 WHERE c = -1) z ON o.id = z.id WHERE c >= 0 AND o.r > 0)",
        f"s AS (SELECT c, sum(r) AS m, sum(r * ({o.c_obs('x', 's2x')} + {o.c_obs('y', 's2y')})) AS co, sum(-{o.plogp('(r + r0)')} + {o.plogp('r0')} + {o.plogp('r')}) AS h FROM k GROUP BY c)",
        "al AS (SELECT c, rk, mux, muy, vx, vy, g1 - 1 AS n1, g2 + e1 AS n2, g1 / g2 AS alpha, a, b FROM cs1, sc1)",
        f"st AS (SELECT k.c, sum({o.c_beta('j.eta1', '(j.eta0 - CASE WHEN k.c > j.c THEN k.rk ELSE 0 END + n1 / n2 - alpha)')}) AS rest FROM al k JOIN cs1 j ON j.c <> k.c GROUP BY k.c)",
    )
    + f"""SELECT al.c, round(coalesce(m, 0) * logp0 - {o.c_beta('(a + coalesce(m, 0))', '(b - coalesce(m, 0))')} + {o.c_beta('a', 'b')}, 2) + 0e0 AS noise,
  round({o.c_alpha('1e0', '1e-2', 'n1 / n2')} - {o.c_alpha('n1', 'n2', 'n1 / n2')} - rest - {o.stick('cs1', '(SELECT g1 FROM sc1)', '(SELECT g2 FROM sc1)')}, 2) + 0e0 AS stick, round(coalesce(h, 0), 2) + 0e0 AS entropy,
  round(-coalesce(co, 0) - {CO0} + {o.c_obs('mux', 'vx')} + {o.c_obs('muy', 'vy')}, 2) + 0e0 AS obs
FROM al LEFT JOIN s ON al.c = s.c JOIN st ON al.c = st.c, prior"""
)
def refine_pass(spark, folder):
    """The gaps of the deletions of all components."""
    gaps = fit.deletion_gaps(_one_step(spark, folder))
    # a zero without a sign
    return gaps.select("c", *((F.round(x, 2) + 0.0).alias(x) for x in ("noise", "stick", "entropy", "obs")))


@query()
def dead_moves(spark, folder):
    """The components that are left after deletions in rounds."""
    return _shown(fit.delete_all(_one_step(spark, folder)).components)


# Surgery on responsibilities

RESP = o.with_(*o.BASE, o.estep(0))
SHOWN_RESP = "SELECT id, c, round(sum(r), 4) AS r FROM ({0}) GROUP BY id, c"


def _shown_resp(model: fit.Model, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The changed responsibilities, added up by point and component: where an id has one point there is nothing to add."""
    again = written(model.points.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_again")), "again")
    shown = lambda rows: rows.select("id", "c", estep.rounded(F.col("r"), 4).alias("r"))
    if again.isEmpty():
        return shown(change(model.every_pair()))
    same = F.col("id").eqNullSafe(F.col("_again"))
    once, more = (change(model.every_pair(model.points.join(again, same, how))) for how in ("left_anti", "left_semi"))
    return shown(once).unionByName(shown(more.groupBy("id", "c").agg(F.sum("r").alias("r"))))


@query(RESP + SHOWN_RESP.format("SELECT id, CASE WHEN c IN (3, 5) THEN -1 WHEN c > 5 THEN c - 2 WHEN c > 3 THEN c - 1 ELSE c END AS c, r FROM r0"))
def resp_remove(spark, folder):
    return _shown_resp(_setup(spark, folder), lambda resp: surgery.remove(resp, [3, 5]))


@query(RESP + SHOWN_RESP.format("SELECT id, CASE WHEN c = 5 THEN 3 WHEN c > 5 THEN c - 1 ELSE c END AS c, r FROM r0"))
def resp_merge(spark, folder):
    return _shown_resp(_setup(spark, folder), lambda resp: surgery.merge(resp, 3, 5))


@query(RESP + SHOWN_RESP.format("SELECT id, CASE WHEN c = -1 AND x < 100 THEN 0 WHEN c = -1 THEN -1 ELSE c + 1 END AS c, r FROM r0"))
def resp_insert(spark, folder):
    model = _setup(spark, folder)
    return _shown_resp(model, lambda resp: surgery.insert_from_noise(resp, model.points.where("x < 100").select("id")))


@query(RESP + SHOWN_RESP.format("SELECT id, CASE WHEN c > 5 THEN c + 1 ELSE c END AS c, r * CASE WHEN c = 5 THEN 0.25e0 ELSE 1e0 END AS r FROM r0 UNION ALL SELECT id, 6, r * 0.75e0 FROM r0 WHERE c = 5"))
def resp_split(spark, folder):
    halves = lambda resp: resp.where("c = 5").withColumn("r1", F.col("r") * 0.25).withColumn("r2", F.col("r") * 0.75)
    return _shown_resp(_setup(spark, folder), lambda resp: surgery.split(resp, 5, halves(resp)))


@query(RESP + "SELECT c, round(sum(r), 3) AS rk FROM (SELECT CASE WHEN c = 5 THEN 3 WHEN c > 5 THEN c - 1 ELSE c END AS c, r FROM r0 WHERE c >= 0) GROUP BY c")
def merge_components(spark, folder):
    return rounded(fit.merge_components(_setup(spark, folder), 3, 5).components.select("c", "rk"), 3, "rk")


@query(RESP + "SELECT c, round(sum(r), 3) AS rk FROM (SELECT CASE WHEN c > 5 THEN c - 2 WHEN c > 3 THEN c - 1 ELSE c END AS c, r FROM r0 WHERE c >= 0 AND c NOT IN (3, 5)) GROUP BY c")
def delete_components(spark, folder):
    return rounded(fit.delete_components(_setup(spark, folder), [3, 5]).components.select("c", "rk"), 3, "rk")


@query(RESP + "SELECT round(sum(r * ln(r)), 2) AS entropy FROM r0 WHERE r >= 1e-10")
def entropy_sum(spark, folder):
    return rounded(estep.entropy(_setup(spark, folder).present()), 2, "entropy")


@query(o.with_(o.PTS) + "SELECT n // 5 AS bucket, count(*) AS n FROM (SELECT count(*) AS n FROM pts GROUP BY floor(x / 10), floor(y / 10)) WHERE n // 5 < 1000 GROUP BY n // 5")
def linear_histogram(spark, folder):
    cells = spatial.with_cells(_points(spark, folder), 10.0).groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"))
    return metrics.bucket_counts(cells, "n", 5)


@query(o.with_(*o.BASE) + "SELECT c, round(mux, 4) AS mux, round(muy, 4) AS muy FROM cen UNION ALL SELECT count(*) + i, 0e0, 0e0 FROM cen, range(3) r(i) GROUP BY i")
def components_append(spark, folder):
    return rounded(surgery.append_empty(views.cell_centres(_points(spark, folder)).select("c", "mux", "muy"), 3), 4, "mux", "muy")


@query(_merge_sql(False))
def gap_merge(spark, folder):
    return _merge_gap(_one_step(spark, folder))


@query(_merge_sql(True))
def gap_merge_fixed(spark, folder):
    return _merge_gap(_one_step(spark, folder, FIXED))


@query(_birth_sql(False))
def gap_birth(spark, folder):
    return _birth_gap(_one_step(spark, folder))


@query(_birth_sql(True))
def gap_birth_fixed(spark, folder):
    return _birth_gap(_one_step(spark, folder, FIXED))


@query(_split_sql(False))
def gap_split(spark, folder):
    return _split_gap(_one_step(spark, folder))


@query(_split_sql(True))
def gap_split_fixed(spark, folder):
    return _split_gap(_one_step(spark, folder, FIXED))


# Spatial joins and initial centres

RHO = "rho AS (SELECT a.id, a.x, a.y, count(*) AS n FROM pts a JOIN pts b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {0} GROUP BY ALL)"
PEAKS = o.with_(
    o.PTS,
    RHO.format(1225),
    "rk AS (SELECT *, row_number() OVER (ORDER BY n DESC, id) AS rank FROM rho)",
    "dl AS (SELECT a.id, a.x, a.y, a.n, a.rank, min(CASE WHEN pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 11025 THEN sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) END) AS d FROM rk a LEFT JOIN rk b ON b.rank < a.rank GROUP BY ALL)",
    "de AS (SELECT id, x, y, n, rank, CASE WHEN rank > 1 THEN coalesce(d, 175e0) END AS d FROM dl)",
)


@query(o.with_(o.PTS, RHO.format(1225)) + "SELECT id, n FROM rho")
def density_rho(spark, folder):
    return spatial.neighbour_counts(_points(spark, folder), 35.0)


@query(PEAKS + "SELECT id, x, y, n AS rho, round(coalesce(d, (SELECT coalesce(max(d), 175e0) FROM de)), 5) AS delta FROM de WHERE coalesce(d, (SELECT coalesce(max(d), 175e0) FROM de)) > 5")
def density_peaks(spark, folder):
    return rounded(spatial.peaks(_points(spark, folder)), 5, "delta")


NEAR = """nb AS (
  SELECT a.id AS a, b.id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d
  FROM pts a JOIN pts b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 400 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) > 0),
nn AS (SELECT a AS id, arg_min(b, (d, b)) AS other, min(d) AS d FROM nb GROUP BY a)"""


@query(o.with_(o.PTS, NEAR) + "SELECT id, other, round(d, 5) AS d FROM nn")
def nearest_neighbour(spark, folder):
    return rounded(spatial.nearest_neighbour(_points(spark, folder)), 5, "d")


@query(o.with_(o.PTS, RHO.format(225), "top AS (SELECT x, y FROM rho ORDER BY n DESC, id LIMIT 1)") + "SELECT p.id FROM pts p, top t WHERE pow(p.x - t.x, 2) + pow(p.y - t.y, 2) <= 225")
def densest_neighbourhood(spark, folder):
    return spatial.densest_neighbourhood(_points(spark, folder))


@query(o.with_(*o.BASE) + "SELECT id, count(c) AS n FROM pts LEFT JOIN cen ON pow(x - mux, 2) + pow(y - muy, 2) < 900 GROUP BY id")
def degree_of_points(spark, folder):
    points = _points(spark, folder)
    return spatial.degree_counters(points, views.cell_centres(points), 30.0)[0]


@query(o.with_(*o.BASE) + "SELECT c, count(id) AS n FROM cen LEFT JOIN pts ON pow(x - mux, 2) + pow(y - muy, 2) < 900 GROUP BY c")
def degree_of_centres(spark, folder):
    points = _points(spark, folder)
    return spatial.degree_counters(points, views.cell_centres(points), 30.0)[1]


@query(o.with_(*o.BASE) + "SELECT a.c, b.c AS other, round(sqrt(pow(a.mux - b.mux, 2) + pow(a.muy - b.muy, 2)), 5) AS d FROM cen a JOIN cen b ON a.c <> b.c AND pow(a.mux - b.mux, 2) + pow(a.muy - b.muy, 2) <= 3600")
def merge_candidates(spark, folder):
    return rounded(spatial.close_centres(views.cell_centres(_points(spark, folder)), 60.0), 5, "d")


@query(
    o.with_(*o.BASE, "near AS (SELECT a.c, b.c AS other FROM cen a JOIN cen b ON a.c <> b.c AND pow(a.mux - b.mux, 2) + pow(a.muy - b.muy, 2) <= 2500)")
    + "SELECT DISTINCT other AS c FROM near WHERE c IN (SELECT c FROM near GROUP BY c HAVING count(*) >= 2)"
)
def nearby_centers(spark, folder):
    return spatial.crowded_centres(views.cell_centres(_points(spark, folder)), 50.0)


@query(STEP + "SELECT c, round(rk, 3) AS rk FROM cs1 WHERE rk < 1.5")
def empty_components(spark, folder):
    return rounded(mstep.empty_components(_one_step(spark, folder).components).select("c", "rk"), 3, "rk")


@query(o.with_(o.PTS) + "SELECT bucket, count(*) AS cells, CAST(sum(n) AS BIGINT) AS points FROM (SELECT length(bin(count(*))) AS bucket, count(*) AS n FROM pts GROUP BY floor(x / 10), floor(y / 10)) GROUP BY bucket")
def log2_histogram(spark, folder):
    return spatial.leaf_histogram(_points(spark, folder), 10.0)


EMB = """emb AS (SELECT vec_id AS id, 1000e0 * embedding[1] AS x, 1000e0 * embedding[2] AS y, 1000e0 * embedding[3] AS z, 100e0 + label AS s2, label AS truth FROM embeddings)"""
SEEDS = "k0 AS (SELECT truth AS c, avg(x) AS mux, avg(y) AS muy, avg(z) AS muz, 0 AS n FROM emb GROUP BY truth)"


def _lloyd(i: int) -> str:
    return f"""a{i} AS (SELECT e.id, e.x, e.y, e.z, arg_min(k.c, (pow(x - mux, 2) + pow(y - muy, 2) + pow(z - muz, 2), k.c)) AS c FROM emb e, k{i} k GROUP BY ALL),
k{i + 1} AS (SELECT k.c, coalesce(avg(x), any_value(mux)) AS mux, coalesce(avg(y), any_value(muy)) AS muy, coalesce(avg(z), any_value(muz)) AS muz, count(a.id) AS n FROM k{i} k LEFT JOIN a{i} a ON k.c = a.c GROUP BY k.c)"""


@query(o.with_(EMB, SEEDS, *map(_lloyd, range(5))) + f"SELECT c, n, {o.rounded(4, 'mux', 'muy', 'muz')} FROM k5")
def kmeans_lloyd_5(spark, folder):
    points = views.embedding_points(spark, folder)
    seeds = points.groupBy(F.col("truth").alias("c")).agg(*(F.avg(a).alias(f"mu{a}") for a in "xyz"))
    return rounded(spatial.kmeans(points, seeds, 5, tuple("xyz")), 4, "mux", "muy", "muz")


WM = "wm AS (SELECT truth, sum(x / s2) / sum(1 / s2) AS mux, sum(y / s2) / sum(1 / s2) AS muy, sum(z / s2) / sum(1 / s2) AS muz FROM emb GROUP BY truth)"


@query(o.with_(EMB, WM) + f"SELECT truth, {o.rounded(4, 'mux', 'muy', 'muz')} FROM wm")
def weighted_means(spark, folder):
    return rounded(metrics.weighted_means(views.embedding_points(spark, folder), "truth", tuple("xyz")), 4, "mux", "muy", "muz")


@query(o.with_(EMB, WM) + "SELECT id AS c, arg_min(w.truth, (sqrt(pow(x - mux, 2) + pow(y - muy, 2) + pow(z - muz, 2)), w.truth)) AS truth, round(min(sqrt(pow(x - mux, 2) + pow(y - muy, 2) + pow(z - muz, 2))), 4) AS d FROM emb, wm w GROUP BY id")
def nearest_truth(spark, folder):
    points = views.embedding_points(spark, folder)
    found = points.select(F.col("id").alias("c"), *(F.col(a).alias(f"mu{a}") for a in "xyz"))
    return rounded(metrics.nearest_truth(found, metrics.weighted_means(points, "truth", tuple("xyz")), tuple("xyz")), 4, "d")


@query(o.with_(EMB) + "SELECT truth, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(quantile_cont(x, 0.025), 4) AS low, round(quantile_cont(x, 0.975), 4) AS high FROM emb GROUP BY truth")
def trace_summary(spark, folder):
    return rounded(metrics.trace_summary(views.embedding_points(spark, folder), "truth", "x"), 4, "mean", "median", "low", "high")


ERF = "(1 - (t * (0.254829592e0 + t * (-0.284496736e0 + t * (1.421413741e0 + t * (-1.453152027e0 + t * 1.061405429e0))))) * exp(-z * z / 2))"


@query(
    o.with_(EMB, "m AS (SELECT avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM emb)")
    + f"""SELECT n, round(max(greatest(hi / n - f, f - lo / n)), 5) AS d FROM (
  SELECT n, hi, lo, 0.5e0 * (1 + sign(z) * {ERF}) AS f FROM (
    SELECT n, hi, lo, z, 1 / (1 + 0.3275911e0 * abs(z) / sqrt(2e0)) AS t FROM (
      SELECT n, (x - m) / s AS z, count(*) OVER (ORDER BY x) AS hi, rank() OVER (ORDER BY x) - 1 AS lo FROM emb, m))) GROUP BY n"""
)
def ks_stat(spark, folder):
    return rounded(metrics.ks_statistic(views.embedding_points(spark, folder), "x").drop("p"), 5, "d")


NORMAL = f"""SELECT n, max(greatest(hi / n - f, f - lo / n)) AS d FROM (
  SELECT n, hi, lo, 0.5e0 * (1 + sign(z) * {ERF}) AS f FROM (
    SELECT n, hi, lo, z, 1 / (1 + 0.3275911e0 * abs(z) / sqrt(2e0)) AS t FROM (
      SELECT n, (x - 0) / 150e0 AS z, count(*) OVER (ORDER BY x) AS hi, rank() OVER (ORDER BY x) - 1 AS lo FROM emb, (SELECT count(*) AS n FROM emb)))) GROUP BY n"""


@query(
    o.with_(EMB)
    + f"""SELECT n, round(d, 5) AS d, round(CASE WHEN d * sqrt(n) < 0.2 THEN 1e0 ELSE greatest(0e0, least(1e0,
  (SELECT sum(CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END * exp(-2e0 * k * k * d * d * n)) FROM range(1, 100) r(k)))) END, 5) AS p FROM ({NORMAL})"""
)
def ks_test(spark, folder):
    """Against a normal distribution of given mean and standard deviation."""
    return rounded(metrics.ks_statistic(views.embedding_points(spark, folder), "x", 0.0, 150.0), 5, "d", "p")


PAIRS = """g AS (SELECT truth % 3 AS separation, x, y FROM emb),
sm AS (SELECT separation, CAST(count(x) AS DOUBLE) * count(y) AS n, sqrt((var_pop(x) + var_pop(y)) * n / (n - 1)) * pow(n, -0.2e0) AS h FROM g GROUP BY separation),
bx AS (SELECT g.separation, floor(x * 50 / h) AS b, count(*) AS k FROM g JOIN sm ON g.separation = sm.separation GROUP BY 1, 2),
by_ AS (SELECT g.separation, floor(y * 50 / h) AS b, count(*) AS k FROM g JOIN sm ON g.separation = sm.separation GROUP BY 1, 2),
den AS (SELECT bx.separation, sum(bx.k * by_.k * exp(-0.5e0 * pow((bx.b - by_.b) / 50e0, 2))) AS s FROM bx JOIN by_ ON bx.separation = by_.separation AND abs(bx.b - by_.b) <= 400 GROUP BY 1),
fac AS (SELECT sm.separation, coalesce(s, 0) / (n * h) * 100 AS factor FROM sm LEFT JOIN den ON sm.separation = den.separation)"""


@query(
    o.with_(EMB, PAIRS)
    + f"""SELECT g.separation, count(x) AS n_left, count(y) AS n_right, round(avg(x), 4) AS mean_left, round(avg(y), 4) AS mean_right, round(avg(y) - avg(x), 4) AS distance,
  round(avg(y) - avg(x) - 1.96e0 * sqrt(var_samp(x) + var_samp(y)), 4) AS low, round(avg(y) - avg(x) + 1.96e0 * sqrt(var_samp(x) + var_samp(y)), 4) AS high, round(any_value(factor), 4) AS factor
FROM g JOIN fac ON g.separation = fac.separation GROUP BY g.separation"""
)
def comparison_report(spark, folder):
    points = views.embedding_points(spark, folder).withColumn("separation", F.col("truth") % 3)
    found = metrics.comparison_report(points.select("separation", F.col("x").alias("v")), points.select("separation", F.col("y").alias("v")), "v", 100.0)
    return rounded(found, 4, "mean_left", "mean_right", "distance", "low", "high", "factor")


@query(o.with_(*o.BASE) + "SELECT row_number() OVER (ORDER BY floor(mux * 1e6 + 0.3183e0), floor(muy * 1e6 + 0.3183e0), c) - 1 AS c, round(mux + 1e-8, 4) AS mux, round(muy + 1e-8, 4) AS muy FROM cen")
def sorted_centres(spark, folder):
    found = metrics.sorted_centres(views.cell_centres(_points(spark, folder)).select("c", "mux", "muy"))
    # a mean that lies between two rounded values goes up, whatever its last digits
    return rounded(found.withColumns({m: F.col(m) + 1e-8 for m in ("mux", "muy")}), 4, "mux", "muy")


@query(o.with_(EMB) + "SELECT round(avg(exp(-0.5e0 * pow((x - y) / 20, 2)) / (20 * sqrt(2 * pi()))) / (1 / (100 * sqrt(2 * pi()))), 5) AS factor FROM emb")
def bayes_factor(spark, folder):
    points = views.embedding_points(spark, folder).withColumnRenamed("id", "draw")
    return rounded(metrics.bayes_factor(points.select("draw", F.col("x").alias("v")), points.select("draw", F.col("y").alias("v")), "v", 20.0, 100.0), 5, "factor")


# Frames

ACT = "act AS (SELECT DISTINCT frame, c FROM pts JOIN cen ON pow(x - mux, 2) + pow(y - muy, 2) <= 900)"
FRAME = o.with_(
    *o.BASE,
    ACT,
    f"fw AS (SELECT frame, act.c, {o.psi('eta1')} - {o.psi('sum(eta1) OVER (PARTITION BY frame)')} AS lw FROM act JOIN cen ON act.c = cen.c)",
    f"""fl AS (SELECT id, pts.frame, fw.c, lw + {o.LOGN} AS logp FROM pts JOIN fw ON pts.frame = fw.frame JOIN cen ON fw.c = cen.c
  UNION ALL SELECT id, frame, -1, {o.psi('1e0')} - {o.psi('10e0')} + logp0 FROM pts, prior)""",
    "fr AS (SELECT *, exp(logp - top) / sum(exp(logp - top)) OVER (PARTITION BY id) AS r FROM (SELECT *, max(logp) OVER (PARTITION BY id) AS top FROM fl))",
    "facc AS (SELECT f.*, coalesce(nt, 0) AS nt, coalesce(xi, 0) AS xi_t FROM (SELECT frame, sum(CASE WHEN c = -1 THEN r ELSE 0 END) AS acc_0, sum(CASE WHEN c = -1 THEN 0 ELSE r END) AS acc_n0 FROM fr GROUP BY frame) f LEFT JOIN (SELECT frame, count(*) AS nt, sum(eta1) AS xi FROM act JOIN cen ON act.c = cen.c GROUP BY frame) g ON f.frame = g.frame)",
)


def _frame_setup(spark, folder) -> tuple[fit.Model, DataFrame]:
    """The model with the cells' centres, and the weights of components."""
    model = _setup(spark, folder)
    return model, model.components.select("c", F.col("eta1").alias("alpha"))


@query(o.with_(*o.BASE, ACT) + "SELECT frame, c FROM act")
def frame_active(spark, folder):
    points = _points(spark, folder)
    return temporal.active_centres(points, views.cell_centres(points))


@query(FRAME + "SELECT id, frame, c, round(logp, 3) AS logp, round(r, 4) AS r FROM fr")
def frame_estep(spark, folder):
    model = _frame_model(spark, folder)
    there = model.sent()
    if there is not None:
        return near.frame_pairs(model.by_frame, there, digits=(3, 4))
    return rounded(rounded(model.responsibilities().select("id", "frame", "c", "logp", "r"), 4, "r"), 3, "logp")


@query(FRAME + f"SELECT frame, nt, {o.rounded(4, 'acc_0', 'acc_n0')}, round(xi_t, 3) AS xi_t FROM facc")
def frame_accumulators(spark, folder):
    return rounded(rounded(_frame_model(spark, folder).frame_sums().select("frame", "acc_0", "acc_n0", "nt", "xi_t"), 4, "acc_0", "acc_n0"), 3, "xi_t")


@query(FRAME + "SELECT c, round(sum(1 / xi_t), 5) AS rk2 FROM act JOIN facc ON act.frame = facc.frame WHERE xi_t > 0 GROUP BY c")
def centre_frame_weight(spark, folder):
    model, weights = _frame_setup(spark, folder)
    return rounded(temporal.centre_weights(temporal.frame_tables(model.points, model.components, weights)), 5, "rk2")


@query(FRAME + "SELECT frame, round(sum(r * ln(r)), 4) AS entropy FROM fr WHERE c <> -1 AND r > 1e-10 GROUP BY frame")
def frame_entropy(spark, folder):
    return rounded(_frame_model(spark, folder).frame_sums().where("seen > 0").select("frame", "entropy"), 4, "entropy")


# The model with frames: a step, its bound and the gaps of its moves after a step


def _frame_local(i: int) -> str:
    """Responsibilities ``fr`` with the points' columns from the components ``fcs`` and the posterior ``fsc`` of the share of noise."""
    return f"""fact{i} AS (SELECT DISTINCT frame, c FROM pts JOIN fcs{i} ON pow(x - mux, 2) + pow(y - muy, 2) <= 900),
fw{i} AS (SELECT frame, k.c, {o.psi('alpha')} - {o.psi('sum(alpha) OVER (PARTITION BY frame)')} AS lw FROM fact{i} k JOIN fcs{i} j ON k.c = j.c),
fl{i} AS (SELECT id, pts.frame, x, y, s2x, s2y, w.c, lw + {o.LOGN} AS logp FROM pts JOIN fw{i} w ON pts.frame = w.frame JOIN fcs{i} j ON w.c = j.c
  UNION ALL SELECT id, frame, x, y, s2x, s2y, -1, {o.psi('a')} - {o.psi('b')} + logp0 FROM pts, fsc{i}, prior),
fr{i} AS (SELECT *, exp(logp - top) / sum(exp(logp - top)) OVER (PARTITION BY id) AS r FROM (SELECT *, max(logp) OVER (PARTITION BY id) AS top FROM fl{i}))"""


def _frame_global(i: int) -> str:
    j = i + 1
    return f"""fst{i} AS (SELECT c, sum(r) AS rk, sum(r * x / s2x) AS xxx, sum(r * y / s2y) AS xxy, sum(r / s2x) AS sxx, sum(r / s2y) AS sxy FROM fr{i} GROUP BY c),
fsu{i} AS (SELECT sum(CASE WHEN c = -1 THEN r ELSE 0 END) AS r0, sum(CASE WHEN c = -1 THEN 0 ELSE r END) AS r1, sum({o.plogp('r')}) AS entropy,
  -0.5e0 * sum(CASE WHEN c = -1 THEN 0 ELSE r * (x * x / s2x + ln(2 * pi() * s2x) + y * y / s2y + ln(2 * pi() * s2y)) END) AS cobs FROM fr{i}),
fcs{j} AS (SELECT k.c, (coalesce(xxx, 0) + mu0x / sigma02) / (coalesce(sxx, 0) + 1 / sigma02) AS mux, (coalesce(xxy, 0) + mu0y / sigma02) / (coalesce(sxy, 0) + 1 / sigma02) AS muy,
  1 / (coalesce(sxx, 0) + 1 / sigma02) AS vx, 1 / (coalesce(sxy, 0) + 1 / sigma02) AS vy, coalesce(t.rk, 0) AS rk, alpha FROM fcs{i} k LEFT JOIN fst{i} t ON k.c = t.c, prior),
fsc{j} AS (SELECT 1 + r0 AS a, 10 + r1 AS b FROM fsu{i})"""


FRAMED = o.with_(*o.BASE, "fcs0 AS (SELECT c, mux, muy, vx, vy, n AS rk, eta1 AS alpha FROM cen)", "fsc0 AS (SELECT 1e0 AS a, 10e0 AS b)", _frame_local(0), _frame_global(0))


def _frame_model(spark, folder) -> frames.FrameModel:
    points = _table(spark, folder)
    return frames.start(points, views.cell_centres(points), fit.Config(prune=False))


@query(FRAMED + f"SELECT c, {o.rounded(4, 'mux', 'muy', 'vx', 'vy')}, {o.rounded(3, 'rk', 'alpha')} FROM fcs1")
def frame_step(spark, folder):
    return rounded(rounded(frames.step(_frame_model(spark, folder)).components, 4, "mux", "muy", "vx", "vy"), 3, "rk", "alpha")


@query(
    FRAMED
    + f"""SELECT round(r0 * logp0 + {o.c_beta('1e0', '10e0')} - {o.c_beta('a', 'b')}, 2) AS e_noise,
  round((SELECT count(*) FROM fcs1) * {CO0} + cobs - {_centre_sql('fcs1')}, 2) AS e_obs,
  round((SELECT sum(lgamma(alpha) - lgamma(10e0)) FROM fcs1), 2) AS e_share, round(-entropy, 2) AS e_ent FROM fsu0, fsc1, prior"""
)
def frame_elbo_terms(spark, folder):
    model = _frame_model(spark, folder)
    after, sums = frames.global_step(model)
    return rounded(frames.bound(sums, after), 2, "e_noise", "e_obs", "e_share", "e_ent").drop("elbo")


def _frame_gap_sql(parts: list[str], noise: str | None, share: str, entropy: str, obs: str, source: str) -> str:
    moved = f"({noise}) * logp0 - {o.c_beta(f'(a + ({noise}))', f'(b - ({noise}))')} + {o.c_beta('a', 'b')}" if noise else "0e0"
    select = f"SELECT {moved} AS noise, {share} AS stick, {entropy} AS entropy, {obs} AS obs FROM {source}"
    return FRAMED.rstrip() + ",\n" + ",\n".join([_frame_local(1), *parts]) + f",\ngap AS ({select})\nSELECT {o.GAP} FROM gap"


_ALPHA = "(SELECT alpha FROM fcs1 WHERE c = {0})"


def _frame_model_stepped(spark, folder, *only: int) -> tuple[frames.FrameModel, DataFrame]:
    model = frames.step(_frame_model(spark, folder))
    return model, written(model.present(list(only)), "resp")


@query(
    _frame_gap_sql(
        [
            "k AS (SELECT o.*, z.r AS r0 FROM fr1 o JOIN (SELECT id, r FROM fr1 WHERE c = -1) z ON o.id = z.id WHERE c = 5 AND o.r > 0)",
            f"s AS (SELECT coalesce(sum(r), 0) AS m, coalesce(sum(r * ({o.c_obs('x', 's2x')} + {o.c_obs('y', 's2y')})), 0) AS co, coalesce(sum(-{o.plogp('(r + r0)')} + {o.plogp('r0')} + {o.plogp('r')}), 0) AS h FROM k)",
        ],
        "m", f"lgamma(10e0) - lgamma({_ALPHA.format(5)})", "h", f"-co - {CO0} + {_centre_sql('fcs1', 'WHERE c = 5')}", "s, fsc1, prior",
    )
)
def frame_gap_delete(spark, folder):
    return _shown_gap(frames.gap_delete(*_frame_model_stepped(spark, folder, 5, estep.NOISE), 5))


@query(
    _frame_gap_sql(
        [
            f"k AS (SELECT id, x, y, s2x, s2y, sum(r) AS r, sum({o.plogp('r')}) AS apart FROM fr1 WHERE c IN (3, 5) GROUP BY id, x, y, s2x, s2y)",
            o.new_centre("m", "k", "r"),
            f"s AS (SELECT sum(apart - {o.plogp('r')}) AS h FROM k)",
        ],
        None, f"lgamma({_ALPHA.format(3)} + {_ALPHA.format(5)} - 10e0 / (SELECT count(*) FROM fcs1)) - lgamma({_ALPHA.format(3)}) - lgamma({_ALPHA.format(5)}) + lgamma(10e0)",
        "h", f"-{CO0} - {_centre_sql('m')} + {_centre_sql('fcs1', 'WHERE c IN (3, 5)')}", "s, prior",
    )
)
def frame_gap_merge(spark, folder):
    return _shown_gap(frames.gap_merge(*_frame_model_stepped(spark, folder, 3, 5), 3, 5))


@query(
    _frame_gap_sql(
        ["k AS (SELECT * FROM fr1 WHERE c = -1 AND x < 100)", o.new_centre("m", "k", "r")],
        "-rk", "lgamma(1 + rk) - lgamma(10e0)", "0e0", f"co + {CO0} - {_centre_sql('m')}", "m, fsc1, prior",
    )
)
def frame_gap_birth(spark, folder):
    model, resp = _frame_model_stepped(spark, folder, estep.NOISE)
    return _shown_gap(frames.gap_birth(model, written(resp.where("c = -1 and x < 100"), "noise")))


@query(
    _frame_gap_sql(
        [
            "k AS (SELECT *, r * CASE WHEN x < (SELECT mux FROM fcs1 WHERE c = 5) THEN 0.9e0 ELSE 0.1e0 END AS ra FROM fr1 WHERE c = 5 AND r > 0)",
            o.new_centre("ma", "k", "ra"),
            o.new_centre("mb", "k", "(r - ra)"),
            f"s AS (SELECT sum({o.plogp('r')} - {o.plogp('ra')} - {o.plogp('(r - ra)')}) AS h FROM k)",
            f"w AS (SELECT {_ALPHA.format(5)} + 10e0 / (1 + (SELECT count(*) FROM fcs1)) AS whole, (SELECT rk FROM ma) / ((SELECT rk FROM ma) + (SELECT rk FROM mb)) AS part)",
        ],
        None, f"lgamma(whole * part) + lgamma(whole * (1 - part)) - lgamma({_ALPHA.format(5)}) - lgamma(10e0)",
        "h", f"{CO0} - {_centre_sql('ma')} - {_centre_sql('mb')} + {_centre_sql('fcs1', 'WHERE c = 5')}", "s, w, prior",
    )
)
def frame_gap_split(spark, folder):
    model, resp = _frame_model_stepped(spark, folder, 5)
    at = float(model.components.where("c = 5").first()["mux"])
    rows = resp.where("c = 5 and r > 0").withColumn("r1", F.col("r") * F.when(F.col("x") < at, 0.9).otherwise(0.1))
    return _shown_gap(frames.gap_split(model, written(rows.withColumn("r2", F.col("r") - F.col("r1")), "proposed"), 5))


def _frame_bound_sql(i: int) -> str:
    beta = lambda a, b: o.c_beta(a, b)
    return f"""SELECT {i} AS iteration, round(r0 * logp0 + {beta('1e0', '10e0')} - {beta('a', 'b')} + (SELECT count(*) FROM fcs{i + 1}) * {CO0} + cobs - {_centre_sql(f'fcs{i + 1}')}
  + (SELECT sum(lgamma(alpha) - lgamma(10e0)) FROM fcs{i + 1}) - entropy, 2) AS elbo, (SELECT count(*) FROM fcs{i + 1}) AS components FROM fsu{i}, fsc{i + 1}, prior"""


@query(FRAMED.rstrip() + "".join(f",\n{_frame_local(i)},\n{_frame_global(i)}" for i in (1, 2, 3)) + "\n" + " UNION ALL ".join(map(_frame_bound_sql, range(4))))
def frame_bounds(spark, folder):
    """The bound of the first four steps of the model with frames."""
    model = _frame_model(spark, folder)
    for _ in range(4):
        model = frames.step(model)
    rows = [(h["iteration"], round(h["elbo"], 2), h["components"]) for h in model.history]
    return spark.createDataFrame(rows, "iteration int, elbo double, components long")


@query()
def frame_fit(spark, folder):
    """The fit of the model with frames, to the tolerance or 100 iterations."""
    points = _table(spark, folder)
    model = frames.fit(frames.start(points, views.cell_centres(points), fit.Config()))
    return rounded(rounded(model.components, 4, "mux", "muy", "vx", "vy"), 3, "rk", "alpha")


@query()
def frame_transitions(spark, folder):
    """The posterior of the four states' transitions after a step."""
    return rounded(frames.with_transitions(frames.step(_frame_model(spark, folder))).transitions, 4, "alpha")


TRANS = """
SELECT i, j, CAST(CASE WHEN i = 0 AND j = 0 THEN s0 WHEN i = 0 AND j = 1 THEN n WHEN i = 1 AND j = 1 THEN s1 WHEN i = 1 AND j = 2 THEN s2 WHEN i = 2 AND j = 1 THEN s2
  WHEN i = 2 AND j = 2 THEN s3 ELSE 0 END AS BIGINT) AS n
FROM (SELECT sum(f) AS s0, count(*) AS n, sum(o) AS s1, sum(d) AS s2, sum(s) AS s3 FROM (
  SELECT u, min(frame) AS f, count(*) FILTER (WHERE gap = 1) AS o, count(*) FILTER (WHERE gap > 1) AS d, coalesce(sum(gap - 2) FILTER (WHERE gap > 1), 0) AS s FROM (
    SELECT u, frame, frame - lag(frame) OVER (PARTITION BY u ORDER BY frame) AS gap FROM (SELECT DISTINCT y AS u, frame FROM pts)) GROUP BY u)),
  range(4) a(i), range(4) b(j)"""


@query(o.with_(o.PTS) + TRANS)
def transition_counts(spark, folder):
    return temporal.transition_counts(_points(spark, folder).select(F.col("y").alias("c"), "frame"))


CHAIN = """WITH RECURSIVE ev AS (SELECT CAST(user_id AS DOUBLE) * 3 AS seq, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events),
ends AS (SELECT min(hour) AS first, max(hour) AS last FROM ev),
grid AS (SELECT seq, t, coalesce(n, 0) AS n FROM (SELECT seq, unnest(range(0, last - first + 1)) AS t FROM (SELECT DISTINCT seq FROM ev), ends)
  LEFT JOIN (SELECT seq AS s, hour - first AS f, count(*) AS n FROM ev, ends GROUP BY 1, 2) ON seq = s AND t = f),
soft AS (SELECT seq, t, exp(-0.05e0 + n * ln(0.05e0)) AS e0, exp(-1e0) AS e1 FROM grid),
fw(seq, t, a0, a1, ls) AS (
  SELECT seq, t, e0 / (e0 + e1), e1 / (e0 + e1), ln(0.5e0 * e0 + 0.5e0 * e1) FROM soft WHERE t = 0
  UNION ALL SELECT seq, t, b0 / (b0 + b1), b1 / (b0 + b1), ls + ln(b0 + b1) FROM (
    SELECT f.seq, s.t, (a0 * 0.95e0 + a1 * 0.2e0) * e0 AS b0, (a0 * 0.05e0 + a1 * 0.8e0) * e1 AS b1, ls FROM fw f JOIN soft s ON f.seq = s.seq AND s.t = f.t + 1)),
bw(seq, t, b0, b1) AS (
  SELECT seq, last - first, 0.5e0, 0.5e0 FROM (SELECT DISTINCT seq FROM ev), ends
  UNION ALL SELECT seq, t, c0 / (c0 + c1), c1 / (c0 + c1) FROM (
    SELECT b.seq, b.t - 1 AS t, 0.95e0 * e0 * b0 + 0.05e0 * e1 * b1 AS c0, 0.2e0 * e0 * b0 + 0.8e0 * e1 * b1 AS c1 FROM bw b JOIN soft s ON b.seq = s.seq AND s.t = b.t WHERE b.t > 0)),
ev_ AS (SELECT seq, ls FROM fw, ends WHERE t = last - first)
SELECT fw.seq, fw.t, round(a0 * b0 / (a0 * b0 + a1 * b1), 6) AS p_off, round(a1 * b1 / (a0 * b0 + a1 * b1), 6) AS p_on, round(ev_.ls, 4) AS log_evidence
FROM fw JOIN bw ON fw.seq = bw.seq AND fw.t = bw.t JOIN ev_ ON fw.seq = ev_.seq"""


@query(CHAIN)
def forward_backward(spark, folder):
    """Smoothed on and off states of each user from the number of events in each frame; a chain for each user."""
    # frames are hours from the first event on, so months don't fold onto each other
    points = views.table(spark, folder, "events").select((F.col("user_id") * 3.0).alias("seq"), F.floor(F.unix_timestamp("ts") / 3600).alias("hour"))
    ends = points.agg(F.min("hour").alias("first"), F.max("hour").alias("last"))
    counts = points.crossJoin(F.broadcast(ends)).groupBy("seq", (F.col("hour") - F.col("first")).cast("int").alias("frame")).agg(F.count("*").alias("n"))
    frames = F.sequence(F.lit(0), (F.col("last") - F.col("first")).cast("int"))
    full = counts.select("seq").distinct().crossJoin(F.broadcast(ends)).select("seq", F.explode(frames).alias("frame")).join(counts, ["seq", "frame"], "left").na.fill(0, ["n"])
    logp = F.array(-F.lit(0.05) + F.col("n") * F.ln(F.lit(0.05)), -F.lit(1.0) + F.col("n") * F.ln(F.lit(1.0)))
    found = temporal.smooth(full.select("seq", F.col("frame").alias("t"), logp.alias("logp")), [0.5, 0.5], [[0.95, 0.05], [0.2, 0.8]])
    return found.select("seq", "t", F.round(F.col("p")[0], 6).alias("p_off"), F.round(F.col("p")[1], 6).alias("p_on"), F.round("log_evidence", 4).alias("log_evidence"))


# Generators

def _uniform(seed: int, key: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {seed}, {key})), 1, 8) AS BIGINT) / 4294967296e0)"


NOISY = ", ".join(f"lo_{a} - (hi_{a} - lo_{a}) / 2 + {_uniform(12 + k, 'id')} * (hi_{a} - lo_{a} + 2 * ((hi_{a} - lo_{a}) / 2)) AS {a}" for k, a in enumerate("xy"))


@query(
    o.with_(o.PTS, "box AS (SELECT min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y FROM pts)")
    + f"""SELECT id, frame, round(x, 4) AS x, round(y, 4) AS y, s2x, s2y, truth FROM (
  SELECT id, frame, x, y, s2x, s2y, 0 AS truth FROM pts UNION ALL SELECT -1 - id, frame, {NOISY}, s2x, s2y, -1 FROM pts, box WHERE {_uniform(11, 'id')} < 0.2)"""
)
def noise_injection(spark, folder):
    return rounded(generators.with_noise(_points(spark, folder), 0.2, 11), 4, "x", "y")


@query(
    o.with_(
        EMB,
        "names AS (SELECT truth AS source, row_number() OVER (ORDER BY md5(concat_ws('|', 5, truth)), truth) - 1 AS k FROM (SELECT DISTINCT truth FROM emb))",
        "nn AS (SELECT * FROM names WHERE k < 9)",
        f"places AS (SELECT p AS truth, (p % 3) * 500e0 AS px, (p // 3) * 500e0 AS py, CAST(floor({_uniform(6, 'p')} * (SELECT count(*) FROM nn)) AS BIGINT) AS k FROM range(9) r(p))",
        "wm AS (SELECT truth AS source, sum(x / s2) / sum(1 / s2) AS mx, sum(y / s2) / sum(1 / s2) AS my FROM emb GROUP BY truth)",
    )
    + "SELECT e.id, p.truth, e.truth AS source, round(e.x - mx + px, 6) AS x, round(e.y - my + py, 6) AS y FROM places p JOIN nn ON p.k = nn.k JOIN emb e ON e.truth = nn.source JOIN wm ON wm.source = nn.source"
)
def grid_generator(spark, folder):
    points = views.embedding_points(spark, folder).withColumn("source", F.col("truth"))
    return generators.grid_of_sources(points, 3, 500.0, 5)[0].select("id", "truth", "source", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(o.with_(EMB) + "SELECT id, " + ", ".join(f"CAST(truth = {k} AS INTEGER) AS z{k + 1}" for k in range(-1, 10)) + " FROM emb")
def truth_one_hot(spark, folder):
    return generators.one_hot(views.embedding_points(spark, folder), 10)


# Initializers and whole fits

@query(
    o.with_(
        o.PTS,
        "rho AS (SELECT a.id, count(*) AS n FROM pts a JOIN pts b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 2500 GROUP BY a.id)",
        "dn AS (SELECT pts.* FROM pts JOIN rho ON pts.id = rho.id WHERE rho.n > 5)",
        "e AS (SELECT a.id AS a, b.id AS b FROM dn a JOIN dn b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 25)",
        "reach(id, label) AS (SELECT a, a FROM e UNION SELECT e.b, r.label FROM reach r JOIN e ON r.id = e.a)",
        "lab AS (SELECT id, min(label) AS label FROM reach GROUP BY id)",
        "gr AS (SELECT row_number() OVER (ORDER BY label) - 1 AS c, avg(x) AS mux, avg(y) AS muy, count(*) AS n FROM lab JOIN pts ON lab.id = pts.id GROUP BY label)",
    ).replace("WITH", "WITH RECURSIVE", 1)
    + f"""SELECT c, n, {o.rounded(4, 'mux', 'muy')}, round(v, 4) AS vx, round(v, 4) AS vy, 1e0 + n AS eta1,
  10e0 + coalesce(sum(n) OVER (ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS eta0
FROM gr, (SELECT (avg(s2x) + avg(s2y)) / 2 AS v FROM pts)"""
)
def init_density(spark, folder):
    return rounded(fit.initial_centres(_points(spark, folder), "density"), 4, "mux", "muy", "vx", "vy")


@query(
    o.with_(
        o.PTS,
        NEAR,
        "e AS (SELECT id AS a, other AS b FROM nn UNION SELECT other, id FROM nn)",
        "reach(id, label) AS (SELECT a, a FROM e UNION SELECT e.b, r.label FROM reach r JOIN e ON r.id = e.a)",
        "lab AS (SELECT id, min(label) AS label FROM reach GROUP BY id)",
        "gr AS (SELECT row_number() OVER (ORDER BY label) - 1 AS c, avg(x) AS mux, avg(y) AS muy, count(*) AS n FROM lab JOIN pts ON lab.id = pts.id GROUP BY label)",
    ).replace("WITH", "WITH RECURSIVE", 1)
    + f"""SELECT c, n, {o.rounded(4, 'mux', 'muy')}, round(v, 4) AS vx, round(v, 4) AS vy, 1e0 + n AS eta1,
  10e0 + coalesce(sum(n) OVER (ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS eta0
FROM gr, (SELECT (avg(s2x) + avg(s2y)) / 2 AS v FROM pts)"""
)
def init_points_refine(spark, folder):
    return rounded(fit.initial_centres(_points(spark, folder), "nearest"), 4, "mux", "muy", "vx", "vy")


@query()
def birth_move(spark, folder):
    return _shown(fit.birth(_one_step(spark, folder)).components)


@query()
def merge_move(spark, folder):
    return _shown(fit.merge(_one_step(spark, folder), 5).components)


@query()
def split_move(spark, folder):
    return _shown(fit.split(_one_step(spark, folder), 5).components)


@query(
    o.with_(*o.BASE, *(x for i in range(4) for x in (o.estep(i), o.mstep(i))))
    + " UNION ALL ".join(f"SELECT {i} AS iteration, round(e_noise + e_obs + e_sb + e_ent, 2) AS elbo, (SELECT count(*) FROM cs{i + 1}) AS components, 'update' AS what FROM el{i + 1}" for i in range(4))
)
def bound_history(spark, folder):
    """The bound of four steps without pruning."""
    model = _setup(spark, folder)
    for _ in range(4):
        model = fit.step(model)
    return rounded(model.history_table(), 2, "elbo")


@query(
    o.with_(*o.BASE, *(x for i in range(3) for x in (o.estep(i, "WHERE pow(x - mux, 2) + pow(y - muy, 2) < 16 * (s2x + s2y) / 2", True), o.mstep(i)))) + CS + "cs3"
)
def vb_3_sparse(spark, folder):
    """Three steps of the sparse kind."""
    model = _setup(spark, folder, fit.Config(prune=False, search_radius=4.0))
    for _ in range(3):
        model = fit.step(model)
    return _shown(model.components)


@query(o.with_(*o.BASE, *(x for i in range(3) for x in (o.estep(i, fixed=True), o.mstep(i, True)))) + CS + "cs3")
def vb_3_fixed(spark, folder):
    """Three steps with a fixed share of noise and concentration."""
    model = _setup(spark, folder, FIXED)
    for _ in range(3):
        model = fit.step(model)
    return _shown(model.components)


@query()
def fit_full(spark, folder):
    points = _table(spark, folder)
    return _shown(fit.fit(fit.start(points, views.cell_centres(points), fit.Config(search_radius=4.0))).components)


@query()
def fit_history(spark, folder):
    points = _table(spark, folder)
    return rounded(fit.fit(fit.start(points, views.cell_centres(points), fit.Config(iterations=4))).history_table(), 2, "elbo")
