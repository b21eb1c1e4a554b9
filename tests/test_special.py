import math

import pytest
from pyspark.sql import functions as F

from mixfield.functions import special as s

VALUES = [1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 123.4, 1e4, 1e6]


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("x")
    return spark.createDataFrame([(v,) for v in VALUES], "x double").select("x", s.lgamma(x).alias("lg"), s.digamma(x).alias("psi"), s.digamma(x + 1).alias("psi1"), s.erf(x).alias("erf"), s.erf(-x).alias("minus"), s.normal_cdf(x).alias("cdf"), s.normal_pdf(x).alias("pdf")).collect()


def test_log_gamma(rows):
    for r in rows:
        want = math.lgamma(r.x)
        assert abs(r.lg - want) <= 1e-11 * max(1, abs(want))


def test_digamma_recurrence_and_values(rows):
    for r in rows:
        assert abs(r.psi1 - r.psi - 1 / r.x) <= 1e-11 * max(1, 1 / r.x)
    one = next(r for r in rows if r.x == 1.0)
    assert abs(one.psi + 0.5772156649015329) < 1e-12
    half = next(r for r in rows if r.x == 0.5)
    assert abs(half.psi + 0.5772156649015329 + 2 * math.log(2)) < 1e-11


def test_error_function(rows):
    for r in rows:
        assert abs(r.erf - math.erf(r.x)) < 2e-7 and r.minus == -r.erf
        assert abs(r.cdf - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 2e-7
        assert abs(r.pdf - math.exp(-r.x * r.x / 2) / math.sqrt(2 * math.pi)) < 1e-12


def test_normalizers(spark):
    a, b = F.lit(2.5), F.lit(4.0)
    r = spark.range(1).select(s.c_beta(a, b).alias("beta"), s.c_gamma(a, b).alias("gamma"), s.c_alpha(a, b, F.lit(0.3)).alias("alpha"), s.c_dirichlet([a, b, F.lit(1.0)]).alias("dir"), s.c_obs(a, b).alias("obs"), s.c_h(a, b).alias("h"), s.gamma_mean(a, b).alias("mean"), s.norm(F.lit(3.0), F.lit(4.0)).alias("norm")).first()
    lg = math.lgamma
    assert abs(r.beta - (lg(6.5) - lg(2.5) - lg(4))) < 1e-11
    assert abs(r.gamma - (2.5 * math.log(4) - lg(2.5))) < 1e-11
    assert abs(r.alpha - (r.gamma - 1.2)) < 1e-11
    assert abs(r.dir - (lg(7.5) - lg(2.5) - lg(4) - lg(1))) < 1e-11
    assert abs(r.obs - r.h) < 1e-12 and r.mean == 0.625 and r.norm == 5.0
