"""Metrics, errors and tests against numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalpanel.operators import align, evaluation, models, stats


def forecasts(spark, actual, predicted):
    rows = [("k", align.plus_months(dt.date(1990, 1, 1), i), float(a), float(p)) for i, (a, p) in enumerate(zip(actual, predicted))]
    return spark.createDataFrame(rows, "k string, period date, actual double, predicted double")


def test_metrics_and_ic(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(-5, 6, 80).astype(float)
    p = a + rng.integers(-4, 5, 80)
    f = forecasts(spark, a, p)
    m = evaluation.metrics(f, "k").first()
    assert m.rmse == pytest.approx(np.sqrt(np.mean((a - p) ** 2))) and m.hit_rate == pytest.approx(np.mean(np.sign(a) == np.sign(p)))
    assert m.r2 == pytest.approx(1 - np.mean((a - p) ** 2) / a.var())
    want = np.corrcoef(pd.Series(a).rank(), pd.Series(p).rank())[0, 1]
    assert evaluation.information_coefficient(f, "k").first().ic == pytest.approx(want)
    assert evaluation.information_coefficient(forecasts(spark, a, np.ones(80)), "k").first().ic == 0


def test_overlap_widens_the_error(spark):
    rng = np.random.default_rng(2)
    walk = rng.standard_normal(240).cumsum()
    y = walk[24:] - walk[:-24]
    f = forecasts(spark, y[1:], y[:-1])
    se = evaluation.rank_errors(f, 24, "k").first().se
    assert se > 1.5 / np.sqrt(len(y))
    assert evaluation.rank_errors(forecasts(spark, y[:20], y[1:21]), 24, "k").first().se is None
    assert evaluation.rank_errors(f, 24, "k", weights="parzen").first().se != se


def test_effective_sizes(spark):
    rng = np.random.default_rng(3)
    noise = rng.standard_normal(200)
    slow = np.zeros(200)
    for i in range(1, 200):
        slow[i] = 0.8 * slow[i - 1] + noise[i]
    size = lambda e: evaluation.effective_sizes(forecasts(spark, e, np.zeros(200)), 24, "k").first()
    assert size(noise).newey_west > 100 and size(slow).newey_west < 100 and size(noise.cumsum()).autocorr < 20
    assert evaluation.effective_sizes(forecasts(spark, np.arange(240.0), np.zeros(240)), 24, "k").first().simple == 10


def _tests(spark, values):
    return spark.createDataFrame([(f"t{i:02d}", float(p)) for i, p in enumerate(values)], "test_id string, p_value double")


def test_corrections(spark):
    counts = lambda values, c: evaluation.corrections(_tests(spark, values)).filter(c).count()
    assert counts([0.001, 0.04] + [0.5] * 8, "bonferroni") == 1
    assert counts([0.001, 0.02, 0.03] + [0.8] * 7, "bh") == 3
    assert counts([0.001, 0.04], "holm") == 2 and counts([0.03, 0.04], "holm") == 0
    q = [r.q_value for r in evaluation.corrections(_tests(spark, [0.01, 0.02, 0.9])).orderBy("p_value").collect()]
    assert q == pytest.approx([0.03, 0.03, 0.9])


def test_ratings(spark):
    df = spark.createDataFrame([(0.12, "equities"), (0.119, "equities"), (0.02, "equities"), (0.35, "equities"), (0.06, "commodities")], "ic double, c string")
    rows = df.select(evaluation.rating(F.col("ic"), F.col("c")).alias("r"), evaluation.suspicious(F.col("ic"), F.col("c")).alias("s")).collect()
    assert [r.r for r in rows] == ["excellent", "good", "poor", "excellent", "good"] and [r.s for r in rows] == [False, False, False, True, False]


def test_stationarity_and_cointegration(spark):
    rng = np.random.default_rng(42)
    walk = rng.standard_normal(200).cumsum()
    series = {"noise": rng.standard_normal(200), "walk": walk, "tied": walk + 0.5 * rng.standard_normal(200), "flat": np.ones(200), "short": np.arange(5.0)}
    rows = [(align.plus_months(dt.date(1990, 1, 1), i), name, float(x)) for name, xs in series.items() for i, x in enumerate(xs)]
    panel = spark.createDataFrame(rows, "period date, series string, value double")
    got = {r.series: r for r in stats.stationarity(panel).collect()}
    assert got["noise"].advice == "stationary" and got["walk"].adf_p > 0.05 and got["short"].adf_p == 1 and got["flat"].adf_p == 1
    pairs = spark.createDataFrame([("p", "walk", "tied"), ("few", "short", "walk")], "name string, a string, b string")
    got = {r.name: r for r in stats.cointegration(panel, pairs).collect()}
    assert got["p"].valid and got["p"].rank >= 1 and abs(got["p"].beta - 1) < 0.2 and not got["few"].valid


def test_kernels():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and stats.t_two_sided(0.0, 5) == pytest.approx(1)
    d = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.9, 0.9], [0.9, 0.9, 0, 0.2], [0.8, 0.9, 0.2, 0]])
    assert stats.average_linkage(list("abcd"), d, 2) == [1, 1, 2, 2]


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 2))
    y = x @ [1.5, -0.5] + 0.3 + 0.1 * rng.standard_normal(60)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, y double")
    fitted = models.ridge(models.vectors(df, ["a", "b"]), 2.0)
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + 2 * np.eye(2), c.T @ (y - y.mean()))
    assert fitted.coefficients.toArray() == pytest.approx(want, abs=1e-8)
    assert models.importances(fitted, ["a", "b"])[0][0] == "a"
    with pytest.raises(ValueError):
        models.ridge(models.vectors(df.limit(5), ["a", "b"]))


def test_upsert_and_consensus(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    new = spark.createDataFrame([("a", 9, "z")], "k string, x int, extra string")
    assert sorted(tuple(r) for r in evaluation.upsert(old, new, "k").collect()) == [("a", 9, "z"), ("b", 2, None)]
    f = spark.createDataFrame([("m1", 1, 0.5), ("m2", 1, -0.1), ("m3", 1, 0.2), ("m1", 2, -1.0)], "model string, period int, predicted double")
    assert {r.period: r.vote for r in evaluation.consensus(f).collect()} == {1: "BULLISH", 2: "BEARISH"}
