"""Tests, intervals and quantiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.functions import stats
from trialspark.functions.nulls import in_set, ratio, strict_mean, strict_sum
from trialspark.operators import quantiles


@pytest.mark.parametrize("k, n, low, high", [
    (0, 1, 0.01257912, 0.84188612), (8, 10, 0.48224415, 0.93978227),
    (10, 10, 0.71508585, 0.99770103), (30, 40, 0.59695376, 0.85778700),
])
def test_beta_interval(spark, k, n, low, high):
    counts = spark.createDataFrame([(k, n)], "k bigint, n bigint")
    got = stats.beta_interval(counts).first()
    assert got["ymin"] == pytest.approx(low, abs=5e-9)
    assert got["ymax"] == pytest.approx(high, abs=5e-9)


def test_beta_interval_of_missing_and_large_counts(spark):
    counts = spark.createDataFrame([(None, 5), (500_000, 1_000_000)], "k bigint, n bigint")
    got = {r["n"]: r for r in stats.beta_interval(counts).collect()}
    assert got[5]["ymin"] is None and got[5]["ymax"] is None
    assert got[1_000_000]["ymin"] == pytest.approx(0.5 - 1.959964 * 0.0005, abs=1e-6)


def test_beta_cdf_is_a_binomial_tail():
    from math import comb
    x, a, b = 0.37, 4, 9
    n = a + b - 1
    tail = sum(comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))
    assert stats.beta_cdf(np.array([x]), np.array([4.0]), np.array([9.0]))[0] == pytest.approx(tail)


def chi(spark, make, *cells):
    df = spark.createDataFrame([cells], ", ".join(f"c{i} bigint" for i in range(len(cells))))
    statistic = make(*(F.col(f"c{i}") for i in range(len(cells))))
    row = df.select(statistic.alias("s")).withColumn("p", stats.chi2_p("s")).first()
    return row["s"], row["p"]


def test_chi_squares(spark):
    s, p = chi(spark, stats.chi2_gof, 15, 9)
    assert (s, p) == (pytest.approx(1.5), pytest.approx(0.220671, abs=1e-6))
    s, p = chi(spark, stats.chi2_2x2, 12, 5, 5, 7)
    assert (s, p) == (pytest.approx(1.3799319973), pytest.approx(0.240113, abs=1e-6))
    s, _ = chi(spark, stats.chi2_2x2, 0, 8, 0, 8)
    assert s is None


def test_critical_values():
    for p, value in stats.CHI2_AT_P.items():
        assert stats.chi2_critical(p + 1e-12) == pytest.approx(value, rel=1e-9)


def test_null_rules(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, None, "b"), (2, 2.0, None), (2, 4.0, "a")],
                               "k bigint, x double, s string")
    got = {r["k"]: r for r in df.groupBy("k").agg(
        strict_sum(F.col("x")).alias("sum"), strict_mean(F.col("x")).alias("mean"),
        strict_sum(F.col("x"), F.col("k") == 3).alias("none"),
    ).collect()}
    assert got[1]["sum"] is None and got[1]["mean"] is None
    assert (got[2]["sum"], got[2]["mean"], got[2]["none"]) == (6.0, 3.0, 0.0)
    assert df.where(~in_set(F.col("s"), ["a"])).count() == 2
    assert df.select(ratio(F.lit(0), F.lit(0)).alias("x")).first()[0] is None


@pytest.mark.parametrize("size", [1, 2, 3, 10, 11, 5000])
def test_exact_quantiles(spark, size):
    rng = random.Random(size)
    values = [rng.choice([rng.gauss(0, 1), 0.0, 1e9, -3.5]) for _ in range(size)]
    probs = {"lo": 0.005, "q1": 0.25, "mid": 0.5, "q3": 0.75, "hi": 0.995, "max": 1.0}
    df = spark.createDataFrame([("g", v) for v in values], "k string, x double")
    got = quantiles.exact_quantiles(df, ["k"], "x", probs).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_quantiles_beyond_the_sketch(spark, monkeypatch):
    # a coarse sketch, so the bracket holds many values and its edges matter
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    monkeypatch.setattr(quantiles, "MARGIN", 4 / 50)
    df = spark.range(40_000).select(
        (F.col("id") % 3).alias("k"), F.pmod(F.hash("id"), F.lit(9973)).cast("double").alias("x")
    )
    got = {r["k"]: r for r in quantiles.exact_quantiles(
        df, ["k"], "x", {"a": 0.1, "b": 0.5}).collect()}
    for r in df.groupBy("k").agg(F.percentile("x", [0.1, 0.5]).alias("p")).collect():
        assert [got[r["k"]]["a"], got[r["k"]]["b"]] == pytest.approx(r["p"])


def test_strict_quantiles(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 5.0), (None, 2.0), (3, None)],
                               "k bigint, x double")
    loose = {r["k"]: r["m"] for r in quantiles.exact_quantiles(
        df, ["k"], "x", {"m": 0.5}).collect()}
    strict = {r["k"]: r["m"] for r in quantiles.exact_quantiles(
        df, ["k"], "x", {"m": 0.5}, strict=True).collect()}
    assert loose == {1: 1.0, 2: 5.0, None: 2.0, 3: None}
    assert strict == {1: None, 2: 5.0, None: 2.0, 3: None}


def test_tails_and_quantiles_in_columns(spark):
    import math
    xs = [0.0, 1e-9, 0.3, 1.0, 2.99, 3.0, 4.2, 9.0, 26.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("p"))
    for x, p in got.collect():
        assert p == pytest.approx(math.erfc(x), rel=1e-9)
    pairs = [(1.0, 1.0), (1.0, 2.0), (1.0, 5000.0), (3.0, 1.0), (40.0, 2.0), (31.0, 11.0), (2e5, 3e5), (1.0, 1e6)]
    frame = spark.createDataFrame(pairs, "a double, b double")
    for p in (0.005, 0.025, 0.5, 0.975, 0.995):
        rows = frame.select("a", "b", stats.beta_quantile_column(p, F.col("a"), F.col("b")).alias("q")).collect()
        for a, b, q in rows:
            assert q == pytest.approx(stats.beta_quantile(p, np.array([a]), np.array([b]))[0], rel=1e-7)


def test_standard_errors_against_finite_differences(spark):
    from trialspark.operators import fit

    rng = np.random.default_rng(2)
    a, b = rng.choice([-0.5, 0.5], (2, 400))
    y = rng.random(400) < 1 / (1 + np.exp(-(0.3 + a - 0.6 * a * b)))
    df = spark.createDataFrame([(float(p), float(q), bool(r)) for p, q, r in zip(a, b, y)],
                               "a double, b double, correct boolean")
    got = fit.fit_with_errors(df, ["a", "b", "a:b"], prior_sd=2.0).collect()
    x = np.stack([np.ones(400), a, b, a * b], axis=1)
    at = np.array([r.estimate for r in got])

    def loss(t):
        z = x @ t
        return np.logaddexp(0, z).sum() - y @ z + (t[1:] ** 2).sum() / 8

    h, eye = 1e-3, np.eye(4)
    curve = np.array([[
        (loss(at + h * (p + q)) - loss(at + h * (p - q)) - loss(at + h * (q - p)) + loss(at - h * (p + q))) / (4 * h * h)
        for q in eye] for p in eye])
    errors = np.sqrt(np.diag(np.linalg.inv(curve)))
    assert np.allclose([r.std_error for r in got], errors, rtol=1e-4)
    assert np.allclose([(r.high - r.low) / 2 for r in got], 1.959964 * errors, rtol=1e-4)


def test_short_chains_keep_every_draw(spark):
    from trialspark.operators import draws

    df = spark.createDataFrame(
        [(c, i, float((7 * i + (c or 3)) % 5)) for c in (0, None) for i in range(9)],
        "chain long, at long, `b_x` double",
    )
    assert draws.draw_trace(df, "chain", "at", pixels=20).count() == 18
    long = draws.draw_trace(df, "chain", "at", pixels=2)
    for r in long.groupBy("chain", "pixel").agg(F.min("position").alias("a"), F.max("position").alias("b")).collect():
        assert (r.a, r.b) in ((0, 4), (5, 8))
