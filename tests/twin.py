"""The model's steps in NumPy, written from the formulas for small inputs."""

import math

import numpy as np


def digamma(x):
    x = np.asarray(x, float)
    h = 1e-5
    lg = np.vectorize(math.lgamma)
    # five-point difference of ln Gamma
    return (-lg(x + 2 * h) + 8 * lg(x + h) - 8 * lg(x - h) + lg(x - 2 * h)) / (12 * h)


lgamma = np.vectorize(math.lgamma)


def c_beta(a, b):
    return lgamma(a + b) - lgamma(a) - lgamma(b)


def c_alpha(a, b, e):
    return a * np.log(b) - lgamma(a) - b * e


def c_obs(mu, s2):
    return -0.5 * (mu**2 / s2 + np.log(2 * np.pi * s2))


def estep(x, s2, mu, v, log_weight, logit):
    logs = np.stack([-0.5 * x.shape[1] * np.log(2 * np.pi) - 0.5 * np.log(s2).sum(1) - (((x - m) ** 2 + w) / (2 * s2)).sum(1) + lw for m, w, lw in zip(mu, v, log_weight)], 1)
    logs = np.concatenate([np.full((len(x), 1), logit), logs], 1)
    r = np.exp(logs - logs.max(1, keepdims=True))
    return r / r.sum(1, keepdims=True)


def entropy(r):
    return (r * np.log(np.clip(r, np.finfo(float).eps, 1))).sum()


def elbo(x, s2, r, mu, v, eta1, eta0, scalars, prior):
    a, b, g1, g2 = scalars
    mean = g1 / g2
    noise = r[:, 0].sum() * prior["logp0"] + c_beta(prior["a"], prior["b"]) - c_beta(a, b)
    cobs = -0.5 * ((1 - r[:, :1]) * (x**2 / s2 + np.log(2 * np.pi * s2))).sum()
    mu0 = np.array([prior["mu0x"], prior["mu0y"]])
    obs = len(mu) * c_obs(mu0, prior["sigma02"]).sum() + cobs - c_obs(mu, v).sum()
    stick = c_alpha(prior["gamma1"], prior["gamma2"], mean) - c_alpha(g1, g2, mean) - c_beta(eta1, eta0).sum()
    return np.array([noise, stick, -entropy(r), obs])


def after(x, s2, r):
    """Posterior means and variances of all components of ``r`` for a prior given later."""
    return r[:, 1:].sum(0), (r[:, 1:, None] * (x / s2)[:, None]).sum(0), (r[:, 1:, None] / s2[:, None]).sum(0)


def centres(xx, sx, prior):
    mu0 = np.array([prior["mu0x"], prior["mu0y"]])
    v = 1 / (sx + 1 / prior["sigma02"])
    return (xx + mu0 / prior["sigma02"]) * v, v
