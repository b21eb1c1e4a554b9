"""Special functions and terms of the variational bound, as expressions that stay in the JVM."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LN_2PI = math.log(2 * math.pi)
#: The argument is shifted up by so much before the asymptotic series.
SHIFT = 8


def digamma(x: Column) -> Column:
    """Derivative of ln Gamma for x > 0, to about 1e-12."""
    x = x.cast("double")
    y = x + SHIFT
    q = 1.0 / (y * y)
    series = F.ln(y) - 0.5 / y - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132))))
    return series - reduce(lambda a, b: a + b, [1.0 / (x + k) for k in range(SHIFT)])


def digamma_value(x: float) -> float:
    """``digamma`` of a number."""
    y = x + SHIFT
    q = 1.0 / (y * y)
    return math.log(y) - 0.5 / y - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132)))) - sum(1.0 / (x + k) for k in range(SHIFT))


def digamma_array(x: np.ndarray) -> np.ndarray:
    """``digamma`` of an array."""
    y = x + SHIFT
    q = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132)))) - sum(1.0 / (x + k) for k in range(SHIFT))


def lgamma_array(x: np.ndarray) -> np.ndarray:
    """``lgamma`` of an array."""
    y = x + SHIFT
    q = 1.0 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * LN_2PI + (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q * (1 / 1680 - q / 1188)))) / y - sum(np.log(x + k) for k in range(SHIFT))


def beta_array(x: np.ndarray, y: np.ndarray, of_x: np.ndarray) -> np.ndarray:
    """``c_beta`` of arrays: ln Gamma(x + y) - ln Gamma(x) - ln Gamma(y), with ``of_x`` = ln Gamma(x); exact where y is far above x as well."""
    z = x + y
    with np.errstate(all="ignore"):
        tail = lambda t: (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * t * t)) / (t * t)) / (t * t)) / (t * t)) / t
        out = (y - 0.5) * np.log1p(x / y) + x * np.log(z) - x + tail(z) - tail(y) - of_x
    low = np.flatnonzero(~(y >= 32))
    if len(low):
        out[low] = lgamma_array(z[low]) - of_x[low] - lgamma_array(y[low])
    return out


def lgamma(x: Column) -> Column:
    """ln Gamma for x > 0, to about 1e-12."""
    x = x.cast("double")
    y = x + SHIFT
    q = 1.0 / (y * y)
    series = (y - 0.5) * F.ln(y) - y + 0.5 * LN_2PI + (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q * (1 / 1680 - q / 1188)))) / y
    return series - F.ln(reduce(lambda a, b: a * b, [x + k for k in range(SHIFT)]))


def erf(x: Column) -> Column:
    """Error function, to about 1e-7 (rational approximation by Abramowitz and Stegun, 7.1.26 with its fixed coefficients)."""
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_pdf(x: Column, mean=0.0, std=1.0) -> Column:
    z = (x - mean) / std
    return F.exp(-0.5 * z * z) / (std * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mean=0.0, std=1.0) -> Column:
    return 0.5 * (1.0 + erf((x - mean) / (std * math.sqrt(2))))


def norm(*parts: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def c_beta(e1: Column, e0: Column) -> Column:
    """Log normalizer of a Beta distribution."""
    return lgamma(e1 + e0) - lgamma(e1) - lgamma(e0)


def c_gamma(a: Column, b: Column) -> Column:
    """Log normalizer of a Gamma distribution of shape a and rate b."""
    return a * F.ln(b) - lgamma(a)


def c_alpha(a: Column, b: Column, mean: Column) -> Column:
    """Log normalizer of a Gamma distribution less rate times a mean."""
    return c_gamma(a, b) - b * mean


def c_dirichlet(alphas: list[Column]) -> Column:
    total = reduce(lambda a, b: a + b, alphas)
    return lgamma(total) - reduce(lambda a, b: a + b, map(lgamma, alphas))


def c_obs(mu: Column, s2: Column) -> Column:
    """Log normalizer of one axis of a Gaussian position."""
    return -0.5 * (mu * mu / s2 + F.ln(2 * math.pi * s2))


def c_h(mu: Column, s2: Column) -> Column:
    """The same with the constant apart."""
    return -0.5 * LN_2PI - 0.5 * F.ln(s2) - 0.5 * mu * mu / s2


def gamma_mean(a: Column, b: Column) -> Column:
    return a / b


def gamma_log_mean(a: Column, b: Column) -> Column:
    return digamma(a) - F.ln(b)


def log_sticks(e1: Column, e0: Column) -> tuple[Column, Column]:
    """Expected logs of a Beta variable and of its complement."""
    both = digamma(e1 + e0)
    return digamma(e1) - both, digamma(e0) - both


def e_log_n(x: list[Column], s2: list[Column], mu: list[Column], sigma2: list[Column]) -> Column:
    """Expected log density of an observation around an uncertain centre."""
    out = F.lit(-0.5 * LN_2PI * len(x))
    for a, s, m, v in zip(x, s2, mu, sigma2, strict=True):
        out = out - 0.5 * F.ln(s) - ((a - m) * (a - m) + v) / (2 * s)
    return out


def plogp(r: Column, eps: float = 2.220446049250313e-16) -> Column:
    """r ln r with r held at eps from below and 1 from above inside the log."""
    return r * F.ln(F.least(F.greatest(r, F.lit(eps)), F.lit(1.0)))
