"""Resampling, stability, vintages and feature pipelines."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_evaluation import forecasts
from tests.test_panels import panel
from tidalpanel.operators import align, models, validation


def test_bootstrap_brackets_the_ic(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal(120)
    f = forecasts(spark, a, a + 0.5 * rng.standard_normal(120))
    r = validation.block_bootstrap(f, 12, 100, 1, "k").first()
    assert 0.6 < r.low < r.high < 1 and r.se > 0
    assert validation.block_bootstrap(f, 12, 100, 1, "k").first() == r
    draws = validation.block_draws(f, 50, 3, 1, "k")
    assert draws.groupBy("rep").count().select("count").distinct().collect()[0][0] == 100


def test_placebo_and_romano_wolf(spark):
    rng = np.random.default_rng(6)
    a = rng.standard_normal(100)
    good, bad = forecasts(spark, a, a + 0.3 * rng.standard_normal(100)), forecasts(spark, a, rng.standard_normal(100))
    both = good.withColumn("model", F.lit("good")).unionByName(bad.withColumn("model", F.lit("bad"))).drop("k")
    got = {r.model: r.significant for r in validation.romano_wolf(both, 5, 100).collect()}
    assert got == {"good": True, "bad": False}
    p = {r.model: r.p_value for r in models.placebo(both, 100, 3, "model").collect()}
    assert p["good"] == 0 and p["bad"] > 0.02


def test_representatives(spark):
    rng = np.random.default_rng(100)
    df = panel(spark, 0.1 * rng.standard_normal(100), 10 * rng.standard_normal(100))
    clusters = spark.createDataFrame([("s0", 1), ("s1", 1)], "feature string, cluster int")
    for how in ("variance", "centroid"):
        assert validation.representatives(df, clusters, how).first().series == "s1"
    assert validation.representatives(df, clusters, "first").first().series == "s0"
    target = df.filter("series = 's0'").select("period", (-F.col("value")).alias("value"))
    assert validation.representatives(df, clusters, "ic", target).first().series == "s0"
    names = spark.createDataFrame([("x_level", 1), ("x_chg_6M", 1), ("y_level", 1), ("x_Q1", 2)], "feature string, cluster int")
    assert [tuple(r) for r in validation.same_base(names).collect()] == [(1, "x", 2)]


def test_vintages_see_their_own_past_only(spark):
    df = panel(spark, np.arange(24.0))
    got = {r.vintage: r for r in validation.known_at(validation.truncated(df)).collect()}
    assert len(got) == 4
    for vintage, r in got.items():
        months = (vintage.year - 2000) * 12 + vintage.month
        assert r.filled == months - 1 and r.zscore == pytest.approx((months - 1 - np.mean(range(months))) / np.std(range(months), ddof=1))


def test_frozen_features_are_exactly_those_wanted(spark):
    df = panel(spark, range(1, 31), range(5, 35))
    codes = df.select("series").distinct().withColumn("code", F.lit(2))
    pairs = spark.createDataFrame([("r", "s0", "s1", "log")], "name string, left string, right string, kind string")
    wanted = spark.createDataFrame([("s0",), ("r_chg_3M",), ("gone",)], "series string")
    out = validation.frozen_features(df, codes, pairs, wanted)
    assert out.count() == 90 and out.filter("value is null").count() == 0
    assert out.filter("series = 'gone' and value <> 0").count() == 0
    every = validation.base_features(df, codes, pairs)
    assert every.groupBy("period", "feature").count().filter("count > 1").count() == 0
    assert {"s0", "r", "r_chg_12M", "s1_zscore_18M", "s0_level"} <= {r[0] for r in every.select("feature").distinct().collect()}


def test_alignment_and_report(spark):
    df = panel(spark, range(10))
    targets = df.select("period", F.col("series").alias("target"), F.col("value").alias("actual"))
    r = validation.alignment(df, targets, 2).first()
    assert (r.rows, r.look_ahead, r["first"]) == (8, 0, dt.date(2000, 3, 1))
    text = validation.report("Title", df.orderBy("period").limit(2))
    assert text.splitlines()[0] == "Title" and "0.0000" in text
    with pytest.raises(ValueError):
        validation.report("Title", df, 5)
    assert align.plus_months(dt.date(2020, 1, 31), 1) == dt.date(2020, 2, 29)
