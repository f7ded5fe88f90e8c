"""Crossed random effects against a dense solution."""

import numpy as np
import pytest

from trialspark.operators.mixed import Effects, fit_mixed_logit

TERMS = ["a", "b", "a:b"]
GROUPS = [Effects(("subject", "source"), ("1", "a")), Effects(("item",), ("1",))]


def trials(subjects, items, seed=5):
    rng = np.random.default_rng(seed)
    own, theirs = rng.normal(0, [0.9, 0.5], (subjects, 2)), rng.normal(0, 0.7, items)
    rows = []
    for s in range(subjects):
        for i in rng.choice(items, 12, replace=False):
            a, b = rng.choice([-0.5, 0.5], 2)
            z = 0.4 + 0.8 * a - 0.3 * b + 0.5 * a * b + own[s] @ [1, a] + theirs[i]
            rows.append((int(s), "x" if s % 2 else "y", int(i), float(a), float(b), bool(rng.random() < 1 / (1 + np.exp(-z)))))
    return rows


def dense(rows, sigma, sd=10.0, rounds=None):
    """Newton's method on the whole matrix; with ``rounds`` also the covariances' updates."""
    x = np.array([[1, a, b, a * b] for *_, a, b, _ in rows])
    y = np.array([r[-1] for r in rows], float)
    subjects, items = sorted({r[0] for r in rows}), sorted({r[2] for r in rows})
    at_s, at_i = {s: i for i, s in enumerate(subjects)}, {t: i for i, t in enumerate(items)}
    p, S, I = x.shape[1], len(subjects), len(items)
    whole = np.zeros((len(rows), p + 2 * S + I))
    whole[:, :p] = x
    for n, (s, _, i, a, _, _) in enumerate(rows):
        whole[n, p + 2 * at_s[s]] = 1
        whole[n, p + 2 * at_s[s] + 1] = a
        whole[n, p + 2 * S + at_i[i]] = 1
    theta = np.zeros(whole.shape[1])
    sigma = [np.array(c, float) for c in sigma]
    for _ in range(rounds or 50):
        penalty = np.zeros((len(theta), len(theta)))
        penalty[:p, :p] = np.eye(p) / sd**2
        for s in range(S):
            at = slice(p + 2 * s, p + 2 * s + 2)
            penalty[at, at] = np.linalg.inv(sigma[0])
        penalty[p + 2 * S :, p + 2 * S :] = np.eye(I) / sigma[1][0, 0]
        chance = 1 / (1 + np.exp(-whole @ theta))
        curve = whole.T @ (whole * (chance * (1 - chance))[:, None]) + penalty
        theta = theta + np.linalg.solve(curve, whole.T @ (y - chance) - penalty @ theta)
        if rounds:
            u = theta[p : p + 2 * S].reshape(S, 2)
            blocks = [np.linalg.inv(curve[p + 2 * s : p + 2 * s + 2, p + 2 * s : p + 2 * s + 2]) for s in range(S)]
            v = theta[p + 2 * S :]
            sigma = [
                (u.T @ u + sum(blocks)) / S,
                np.array([[(v @ v + (1 / np.diag(curve)[p + 2 * S :]).sum()) / I]]),
            ]
    chance = 1 / (1 + np.exp(-whole @ theta))
    if rounds:
        return theta, sigma
    curve = whole.T @ (whole * (chance * (1 - chance))[:, None]) + penalty
    return theta, np.sqrt(np.diag(np.linalg.inv(curve)))[:p]


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "subject long, source string, item long, a double, b double, correct boolean"
    )


def test_coefficients_effects_and_errors_equal_a_dense_solution(spark):
    rows = trials(60, 20)
    sigma = [np.array([[0.8, 0.1], [0.1, 0.3]]), np.array([[0.5]])]
    theta, errors = dense(rows, sigma)
    fitted = fit_mixed_logit(frame(spark, rows), TERMS, GROUPS, covariances=sigma, rounds=4, tolerance=2e-3)
    got = fitted.coefficients.collect()
    assert [r.term for r in got] == ["Intercept", *TERMS]
    assert np.abs(np.array([r.estimate for r in got]) - theta[:4]).max() < 1e-5
    assert np.abs(np.array([r.std_error for r in got]) - errors).max() < 1e-4
    own = {r.subject: r.value for r in fitted.effects["subject:source"].collect()}
    expected = theta[4 : 4 + 120].reshape(60, 2)
    assert max(np.abs(np.array(own[s]) - expected[s]).max() for s in own) < 1e-4
    items = {r.item: r.value[0] for r in fitted.effects["item"].collect()}
    assert max(abs(items[i] - theta[124 + i]) for i in items) < 1e-4


def test_covariances_come_near_a_dense_solution(spark):
    rows = trials(24, 14, seed=9)
    theta, sigma = dense(rows, [np.eye(2), np.eye(1)], rounds=2)
    fitted = fit_mixed_logit(frame(spark, rows), TERMS, GROUPS, rounds=2, tolerance=3e-3, most_steps=18)
    assert np.abs(fitted.covariances["subject:source"] - sigma[0]).max() < 2e-3
    assert np.abs(fitted.covariances["item"] - sigma[1]).max() < 2e-3
    estimates = [r.estimate for r in fitted.coefficients.collect()]
    assert np.abs(np.array(estimates) - theta[:4]).max() < 5e-3


def test_incomplete_rows_are_left_out(spark):
    rows = [(None, "x", 1, 0.5, 0.5, True), (1, "x", 1, None, 0.5, True), (1, "x", 1, 0.5, 0.5, None)]
    with pytest.raises(ValueError, match="no complete rows"):
        fit_mixed_logit(frame(spark, rows), TERMS, GROUPS)
