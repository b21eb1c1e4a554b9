"""SQL for the registered queries: common table expressions that are put together by name."""

from __future__ import annotations

LN_2PI = "1.8378770664093453"


def psi(x: str) -> str:
    """Digamma as the same closed form that the engine uses; SQL has no function for it."""
    x = f"CAST({x} AS DOUBLE)"
    y = f"({x} + 8)"
    series = f"ln({y}) - 0.5e0 / {y} - (1e0/12 - (1e0/120 - (1e0/252 - (1e0/240 - 1e0/132 / pow({y},2)) / pow({y},2)) / pow({y},2)) / pow({y},2)) / pow({y},2)"
    return f"({series} - ({' + '.join(f'1e0/({x} + {k})' for k in range(8))}))"


def c_beta(a: str, b: str) -> str:
    return f"(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))"


def c_alpha(a: str, b: str, e: str) -> str:
    return f"({a} * ln({b}) - lgamma({a}) - {b} * {e})"


def c_obs(mu: str, s2: str) -> str:
    return f"(-0.5e0 * ({mu} * {mu} / {s2} + ln(2 * pi() * {s2})))"


PTS = """pts AS (
  SELECT event_id AS id, CAST((day(ts) - 1) * 24 + hour(ts) AS INTEGER) AS frame, value AS x, CAST(user_id AS DOUBLE) * 3 AS y,
    4e0 + 1e-1 * CAST(props->>'$.k' AS DOUBLE) AS s2x, 4e0 + 1e-1 * CAST(props->>'$.k' AS DOUBLE) AS s2y
  FROM events)"""

PRIOR = """prior AS (
  SELECT *, area * area AS sigma02, -1.5e0 * ln(area) AS logp0 FROM (
    SELECT count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS area, avg(x) AS mu0x, avg(y) AS mu0y, sqrt((avg(s2x) + avg(s2y)) / 2) AS mean_sigma
    FROM pts))"""

CEN = f"""cells AS (
  SELECT floor(x / 50) AS gx, floor(y / 50) AS gy, avg(x) AS mux, avg(y) AS muy, avg(s2x) AS vx, avg(s2y) AS vy, count(*) AS n FROM pts GROUP BY 1, 2),
numbered AS (SELECT row_number() OVER (ORDER BY gx, gy) - 1 AS c, * FROM cells),
cen AS (
  SELECT c, mux, muy, vx, vy, CAST(n AS DOUBLE) AS n, 1e0 + n AS eta1,
    10e0 + coalesce(sum(CAST(n AS DOUBLE)) OVER (ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS eta0
  FROM numbered),
sticks0 AS (SELECT *, {psi("eta1")} - {psi("(eta1 + eta0)")} AS eu, {psi("eta0")} - {psi("(eta1 + eta0)")} AS e1 FROM cen),
cs0 AS (SELECT c, mux, muy, vx, vy, n AS rk, eta1, eta0, eu, e1, eu + coalesce(sum(e1) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw FROM sticks0),
sc0 AS (SELECT 1e0 AS a, 10e0 AS b, 1e0 AS g1, 1e-2 AS g2)"""

LOGN = f"(-{LN_2PI} - 0.5e0 * ln(s2x) - 0.5e0 * ln(s2y) - (pow(x - mux, 2) + vx) / (2 * s2x) - (pow(y - muy, 2) + vy) / (2 * s2y))"


#: Fixed share of noise and concentration.
PI1, ALPHA0 = "0.1e0", "10e0"
LOGIT = f"(ln({PI1} / (1 - {PI1})) + logp0)"


def estep(i: int, near: str = "", cut: bool = False, fixed: bool = False) -> str:
    logit = LOGIT if fixed else f"{psi('a')} - {psi('b')} + logp0"
    weight = "exp(logp - top)"
    if cut:
        weight = f"CASE WHEN logp - top < -50 THEN 0 ELSE {weight} END"
    return f"""l{i} AS (
  SELECT id, x, y, s2x, s2y, c, lw + {LOGN} AS logp FROM pts, cs{i} {near}
  UNION ALL SELECT id, x, y, s2x, s2y, -1, {logit} FROM pts, sc{i}, prior),
w{i} AS (SELECT *, {weight} AS w FROM (SELECT *, max(logp) OVER (PARTITION BY id) AS top FROM l{i})),
r{i} AS (SELECT id, x, y, s2x, s2y, c, logp, w / sum(w) OVER (PARTITION BY id) AS r FROM w{i})"""


def mstep(i: int, fixed: bool = False) -> str:
    """From cs{i}, sc{i} and r{i} to the statistics st{i} and sums su{i}, and cs, sc and el of i + 1."""
    j = i + 1
    alpha = ALPHA0 if fixed else "g1 / g2"
    e_noise = f"r0 * {LOGIT} + (r0 + r1) * ln(1 - {PI1})" if fixed else f"r0 * logp0 + {c_beta('1e0', '10e0')} - {c_beta('a', 'b')}"
    e_sb = stick_fixed(f"cs{j}") if fixed else f"{c_alpha('1e0', '1e-2', 'g1 / g2')} - {c_alpha('g1', 'g2', 'g1 / g2')} - (SELECT sum({c_beta('eta1', 'eta0')}) FROM cs{j})"
    plogp = "r * ln(least(greatest(r, 2.220446049250313e-16), 1e0))"
    return f"""st{i} AS (SELECT c, sum(r) AS rk, sum(r * x / s2x) AS xxx, sum(r * y / s2y) AS xxy, sum(r / s2x) AS sxx, sum(r / s2y) AS sxy, count(*) AS n FROM r{i} GROUP BY c),
su{i} AS (SELECT sum(CASE WHEN c = -1 THEN r ELSE 0 END) AS r0, sum(CASE WHEN c = -1 THEN 0 ELSE r END) AS r1, sum({plogp}) AS entropy,
  -0.5e0 * sum(CASE WHEN c = -1 THEN 0 ELSE r * (x * x / s2x + ln(2 * pi() * s2x) + y * y / s2y + ln(2 * pi() * s2y)) END) AS cobs FROM r{i}),
up{i} AS (
  SELECT o.c, 1 / (coalesce(sxx, 0) + 1 / sigma02) AS vx, 1 / (coalesce(sxy, 0) + 1 / sigma02) AS vy, coalesce(xxx, 0) + mu0x / sigma02 AS tx, coalesce(xxy, 0) + mu0y / sigma02 AS ty,
    coalesce(s.rk, 0) AS rk, {alpha} AS alpha FROM cs{i} o LEFT JOIN st{i} s ON o.c = s.c, prior, sc{i}),
et{i} AS (SELECT *, 1 + rk AS eta1, alpha + coalesce(sum(rk) OVER (ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS eta0 FROM up{i}),
sk{i} AS (SELECT *, {psi("eta1")} - {psi("(eta1 + eta0)")} AS eu, {psi("eta0")} - {psi("(eta1 + eta0)")} AS e1 FROM et{i}),
cs{j} AS (SELECT c, tx * vx AS mux, ty * vy AS muy, vx, vy, rk, eta1, eta0, eu, e1, eu + coalesce(sum(e1) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw FROM sk{i}),
sc{j} AS (SELECT 1 + r0 AS a, 10 + r1 AS b, (SELECT 1e0 + count(*) FROM cs{j}) AS g1, (SELECT 1e-2 - sum(e1) FROM cs{j}) AS g2 FROM su{i}),
el{j} AS (
  SELECT {e_noise} AS e_noise,
    (SELECT count(*) FROM cs{j}) * ({c_obs("mu0x", "sigma02")} + {c_obs("mu0y", "sigma02")}) + cobs - (SELECT sum({c_obs("mux", "vx")} + {c_obs("muy", "vy")}) FROM cs{j}) AS e_obs,
    {e_sb} AS e_sb, -entropy AS e_ent
  FROM su{i}, sc{j}, prior)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (PTS, PRIOR, CEN)


def rounded(digits: int, *names: str) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def stick(cs: str, g1: str, g2: str) -> str:
    """The bound's part of shares, for a table of eta1 and eta0."""
    return f"({c_alpha('1e0', '1e-2', f'({g1}) / ({g2})')} - {c_alpha(f'({g1})', f'({g2})', f'({g1}) / ({g2})')} - (SELECT sum({c_beta('eta1', 'eta0')}) FROM {cs}))"


def stick_fixed(cs: str) -> str:
    """The same with a fixed concentration."""
    return f"((SELECT count(*) FROM {cs}) * {c_beta('1e0', ALPHA0)} - (SELECT sum({c_beta('eta1', 'eta0')}) FROM {cs}))"


#: Components after the change of a move, with eta0 from their counts and the new concentration; ``moved`` gives c, rk and the old eta0's rest.
def moved(name: str, source: str, da: str) -> str:
    return f"{name} AS (SELECT c, 1 + rk AS eta1, base + coalesce(sum(rk) OVER (ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) + ({da}) AS eta0 FROM {source})"


BASED = "based AS (SELECT *, eta0 - coalesce(sum(rk) OVER (ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS base FROM cs1)"
GAP = ", ".join(f"round({n}, 2) AS {n}" for n in ("noise", "stick", "entropy", "obs"))
PLOGP = "({0} * ln(least(greatest({0}, 2.220446049250313e-16), 1e0)))"


def plogp(x: str) -> str:
    return PLOGP.format(x)


def new_centre(name: str, source: str, r: str) -> str:
    """One row ``rk, mux, muy, vx, vy, co`` of the sums of a table with weight ``r``."""
    return f"""{name}s AS (SELECT sum({r}) AS rk, sum({r} * x / s2x) AS xxx, sum({r} * y / s2y) AS xxy, sum({r} / s2x) AS sxx, sum({r} / s2y) AS sxy,
  sum({r} * ({c_obs('x', 's2x')} + {c_obs('y', 's2y')})) AS co FROM {source}),
{name} AS (SELECT rk, co, 1 / (sxx + 1 / sigma02) AS vx, 1 / (sxy + 1 / sigma02) AS vy, (xxx + mu0x / sigma02) / (sxx + 1 / sigma02) AS mux, (xxy + mu0y / sigma02) / (sxy + 1 / sigma02) AS muy FROM {name}s, prior)"""
