"""Inference, revisions, labels, selection and sequences by hand or against numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_evaluation import forecasts
from tidalpanel.operators import align, inference, preprocess, stats, transforms, validation


def test_ic_inference_by_hand(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal(90).cumsum()
    p = a + rng.standard_normal(90)
    r = inference.ic_inference(forecasts(spark, a, p), 6, "k").first()
    z = lambda v: (pd.Series(v).rank() - pd.Series(v).rank().mean()) / pd.Series(v).rank().std(ddof=0)
    u = (z(a) * z(p)).to_numpy()
    c = u - u.mean()
    g = [c[j:] @ c[: len(c) - j] / (len(c) - j) for j in range(6)]
    nw = np.sqrt(max(0, g[0] + 2 * sum((1 - j / 6) * g[j] for j in range(1, 6))) / 90)
    hh = np.sqrt(max(0, g[0] + 2 * sum(g[1:])) / 90)
    assert (r.ic, r.se_nw, r.se_hh, r.t_stat) == pytest.approx((u.mean(), nw, hh, u.mean() / nw))
    assert r.se_raw == pytest.approx(np.sqrt((1 - u.mean() ** 2) / 88))
    df = max(1, r.effective_n - 2)
    assert r.p_value == pytest.approx(stats.t_two_sided(r.t_stat, df)) and stats.t_two_sided((r.ci_high - r.ic) / r.se_nw, df) == pytest.approx(0.05, abs=1e-9)


def test_ic_inference_edges(spark):
    flat = inference.ic_inference(forecasts(spark, np.arange(40.0), np.ones(40)), 6, "k").first()
    assert flat.ic == 0 and flat.se_raw is flat.se_nw is flat.p_value is flat.ci_low is None and flat.effective_n == 6
    short = inference.ic_inference(forecasts(spark, [1.0, 3, 2, 5, 4], [1.0, 2, 3, 4, 5]), 12, "k").first()
    assert short.ic == pytest.approx(0.8) and short.se_nw is short.t_stat is None and short.se_raw > 0


def test_t_quantile():
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.2281389, abs=1e-6) and stats.t_quantile(0.025, 10) == pytest.approx(-2.2281389, abs=1e-6)
    assert stats.t_quantile(0.975, 1) == pytest.approx(12.7062047, abs=1e-5)


def test_revision_and_deployment(spark):
    rows = spark.createDataFrame([(0.2, 0.16, 0.9), (-0.1, 0.1, 0.9), (1e-9, 0.2, None), (0.3, 0.1, 0.71)], "ic double, rt double, stability double")
    out = rows.select(inference.revision_risk(F.col("ic"), F.col("rt")).alias("r"), inference.vintage_revision_risk(F.col("ic"), F.col("rt")).alias("v"), "stability").collect()
    assert out[0].r == pytest.approx(0.2) and out[1].r is None and out[2].v == 0 and out[1].v == pytest.approx(2.0)
    checks = inference.deployable(rows.select(F.col("rt").alias("ic"), ((F.col("ic") - F.col("rt")) / F.col("ic")).alias("risk"), "stability")).collect()
    assert [r.deployable for r in checks] == [True, False, False, False]


def test_feature_stability(spark):
    a = spark.createDataFrame([("m", f"f{i}", float(i)) for i in range(5)] + [("n", "x", 1.0)], "model string, feature string, value double")
    b = a.withColumn("value", -F.col("value"))
    got = {r.model: r for r in inference.feature_stability(a, b, "model").collect()}
    assert got["m"].stability == pytest.approx(-1) and got["n"].stability is None and got["n"].features == 1


def test_decision_matrix_and_weights(spark):
    rows = spark.createDataFrame([(a, k) for a in (True, False) for k in (True, False)], "a boolean, k boolean")
    got = {(r.a, r.k): r.x for r in rows.select("a", "k", stats.advice(F.col("a"), F.col("k")).alias("x")).collect()}
    assert got == {(True, True): "stationary", (True, False): "trend stationary", (False, True): "difference stationary", (False, False): "non-stationary"}
    pairs = spark.createDataFrame([("fisher_hypothesis", 0.5, 0.01, None), ("unknown", 0.01, 0.9, 0.25), ("okun_law", 0.5, None, 1.0)], "name string, j double, p double, share double")
    got = [r[0] for r in pairs.select(stats.pair_weight(F.col("name"), F.col("j"), F.col("p"), stats.steadiness(F.col("share")))).collect()]
    logistic = lambda p: 1 / (1 + np.exp(10 * (p - 0.1)))
    want = [0.6**0.3 * logistic(0.01) ** 0.5, 0.5**0.3 * logistic(0.01) ** 0.5 * 0.4**0.2, 0.4**0.3 * logistic(0.5) ** 0.5]
    assert got == pytest.approx(want)


def test_short_samples_have_half_the_stability(spark):
    rng = np.random.default_rng(8)
    walk = rng.standard_normal(80).cumsum()
    rows = [(align.plus_months(dt.date(1990, 1, 1), i), s, float(v)) for s, vs in (("a", walk), ("b", walk + rng.standard_normal(80))) for i, v in enumerate(vs)]
    panel = spark.createDataFrame(rows, "period date, series string, value double")
    pairs = spark.createDataFrame([("p", "a", "b")], "name string, a string, b string")
    short = validation.rolling_stability(panel, pairs, 60, 12).first()
    assert (short.windows, short.stability, short.factor) == (0, None, 0.5)
    long = validation.rolling_stability(panel, pairs, 40, 12).first()
    assert long.windows == 4 and long.factor >= 0


def test_inverse_of_second_differences(spark):
    values = [5.0, 7.0, 4.0, 9.0, 12.0, 3.0]
    rows = spark.createDataFrame([(align.plus_months(dt.date(1990, 1, 1), i), "s", v) for i, v in enumerate(values)], "period date, series string, value double")
    for code in (2, 3, 5, 6, 7):
        coded = transforms.transform(rows, spark.createDataFrame([("s", code)], "series string, code int"))
        assert [r.back for r in transforms.inverse(coded, code).orderBy("period").collect()] == pytest.approx(values)


def test_outer_folds_and_vintage_dates(spark):
    folds = align.outer_folds(dt.date(1990, 1, 1), dt.date(2010, 1, 1), 2, 120, 24)
    end, start, stop = folds[0]
    assert start == end + dt.timedelta(days=1) and stop == align.plus_months(start, 24)
    got = [str(r.vintage) for r in align.vintage_dates(spark, "2000-01-01", "2001-03-01").collect()]
    assert got == ["2000-06-30", "2000-12-31"]


def test_sequences(spark):
    assert [inference.sequence_length(s, h) for s, h in (("short", 24), ("medium", 24), ("adaptive", 24), ("adaptive", 48), ("adaptive", 10), ("full", 24))] == [6, 12, 12, 12, 5, 24]
    assert inference.sequence_length("medium", 24, 10) == 10
    rows = [(align.plus_months(dt.date(1990, 1, 1), i), "s", None if 50 <= i < 55 else float(i)) for i in range(100)]
    panel = spark.createDataFrame(rows, "period date, series string, value double")
    r = inference.validate_sequences(panel, 12, 1, 100).first()
    assert (r.possible, r.usable, r.valid) == (89, 89 - 16, False) and "Total sequences" in r.reason
    assert inference.validate_sequences(panel, 12, 6, 5).first().possible == 15


def test_as_of_spans(spark):
    rng = np.random.default_rng(3)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=int(n))
    right = [("k", day(n), float(n)) for n in sorted(set(rng.integers(50, 900, 12)))] + [("j", day(10), 1.0)]
    left = [(i, k, day(n)) for i, (k, n) in enumerate([("k", n) for n in rng.integers(0, 1000, 60)] + [("j", 9), ("j", 500), ("z", 5)])]
    a = spark.createDataFrame(left, "id long, key string, d date")
    b = spark.createDataFrame(right, "key string, since date, v double")
    want = {i: max(((s, v) for kk, s, v in right if kk == k and s <= d), default=(None, None))[1] for i, k, d in left}
    for days in (1, 31, 10_000):
        assert {r.id: r.v for r in align.as_of(a, b, ("key",), "d", "since", days).collect()} == want


def test_safe_target_and_modes(spark):
    rows = [(align.plus_months(dt.date(1990, 1, 1), i), float(i)) for i in range(100)]
    y = spark.createDataFrame(rows, "period date, value double")
    assert inference.safe_target(y, 24).count() == 76 and inference.safe_target(y, 24).first().value == 0
    assert inference.safe_target(y, 12, "1997-01-01", 20).agg(F.max("period")).first()[0] == dt.date(1995, 12, 1)
    with pytest.raises(ValueError):
        inference.safe_target(y, 60)
    panel = spark.createDataFrame([(d, s, v * k) for d, v in rows for s, k in (("a", 1.0), ("b", 5.0), ("c", 2.0))], "period date, series string, value double")
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "feature string, cluster int")
    pick = lambda how, **o: {r.cluster: r.series for r in validation.representatives(panel, clusters, how, **o).collect()}
    assert pick("auto") == {1: "b", 2: "c"} and pick("variance", least=200) == {1: "a", 2: "c"} and pick("random") == pick("random")


def test_scalers_never_look_ahead(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(60)
    rows = spark.createDataFrame([(align.plus_months(dt.date(1990, 1, 1), i), "s", float(v)) for i, v in enumerate(x)], "period date, series string, value double")
    s = pd.Series(x)
    for how, window in (("robust", None), ("robust", 12), ("standard", 12)):
        got = [r.value for r in preprocess.scale_expanding(rows, 6, "null", how, window).orderBy("period").collect()]
        roll = s.expanding(6) if window is None else s.rolling(window, min_periods=6)
        centre, spread = (roll.median(), roll.quantile(0.75) - roll.quantile(0.25)) if how == "robust" else (roll.mean(), roll.std())
        want = (s - centre.shift(1)) / spread.shift(1)
        assert [g for g in got if g is not None] == pytest.approx(want.dropna().tolist()) and sum(g is None for g in got) == 6
