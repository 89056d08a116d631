"""Learners against closed forms, and the grouped tournament."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalpanel.operators import align, learners, stats


def test_kernels_meet_their_conditions():
    rng = np.random.default_rng(0)
    x, n = rng.standard_normal((80, 4)) * [1, 2, 3, 4], 80
    y = x @ [1.0, 0.0, -0.5, 0.0] + 0.3 * rng.standard_normal(80) + 2
    c, r = x - x.mean(0), y - y.mean()
    b, intercept = learners.ridge(x, y, 3.0)
    assert np.allclose(c.T @ (r - c @ b), 3.0 * b) and intercept == pytest.approx(y.mean() - x.mean(0) @ b)
    for alpha, ratio in ((0.05, 1.0), (0.05, 0.5)):
        b, _ = learners.elastic_net(x, y, alpha, ratio)
        slope = c.T @ (r - c @ b) / n - alpha * (1 - ratio) * b
        assert np.allclose(slope[b != 0], alpha * ratio * np.sign(b[b != 0]), atol=1e-7) and (np.abs(slope[b == 0]) <= alpha * ratio + 1e-7).all()
    assert (learners.lasso(x, y, 100.0)[0] == 0).all()


def test_network_learns_a_bend_and_repeats():
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, (300, 1))
    y = np.abs(x[:, 0])
    model = learners.mlp(x, y, epochs=400)
    assert np.mean((model(x) - y) ** 2) < 0.05 * y.var() and (learners.mlp(x, y, epochs=400)(x) == model(x)).all()


def test_error_correction_forecasts():
    rng = np.random.default_rng(2)
    walk = rng.standard_normal(200).cumsum()
    y = walk + 0.1 * rng.standard_normal(200)
    said = learners.vecm(np.column_stack([walk, rng.standard_normal(200)]), y, 5)
    assert np.abs(said - y[-1]).max() < 3 and (learners.vecm(np.ones((12, 1)), np.ones(12), 3) == 0).all()


def test_preparation_is_frozen_and_past_only():
    rng = np.random.default_rng(3)
    train = pd.DataFrame({"a": rng.standard_normal(40), "b": np.ones(40), "c": np.nan, "d": rng.standard_normal(40)})
    train.loc[[0, 10], "a"] = np.nan
    prepared, x = learners.prepare(train, ["a", "b", "c", "d"])
    assert prepared.names == ["a", "d"]
    raw = x[:, 0] * prepared.spread[0] + prepared.centre[0]
    assert raw[0] == pytest.approx(0) and raw[10] == pytest.approx(train["a"][:10].median())
    held = prepared.apply(pd.DataFrame({"a": [np.nan], "d": [1.0]}))
    assert held[0, 0] * prepared.spread[0] + prepared.centre[0] == pytest.approx(train["a"].median())


def _design(spark, n=150):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, 2))
    y = x @ [1.0, -1.0] + 0.1 * rng.standard_normal(n)
    rows = [(align.plus_months(dt.date(1990, 1, 1), i), float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "period date, a double, b double, y double")


def test_tournament_is_the_loop(spark):
    data = _design(spark)
    options = dict(train=60, validate=12, step=24)
    got = learners.tournament(data, ["a", "b"], ("ridge", "mlp", "vecm"), "standard", **options).toPandas()
    frame = data.toPandas().sort_values("period")
    for fold, start, end, vs, ve in align.fold_bounds(frame["period"].min(), frame["period"].max(), **options):
        train, validate = frame[(frame["period"] >= start) & (frame["period"] <= end)], frame[(frame["period"] >= vs) & (frame["period"] <= ve)]
        want = learners.answer("ridge", train, validate, ["a", "b"], "standard")
        mine = got[(got["model"] == "ridge") & (got["fold_id"] == fold)].sort_values("period")["predicted"]
        assert mine.to_numpy() == pytest.approx(want)
    board = {r.model: r for r in learners.leaderboard(spark.createDataFrame(got.drop(columns="failed"))).collect()}
    assert board["ridge"].rank == 1 and board["ridge"].ic_mean > 0.9 and board["ridge"].significant
    few = learners.tournament(data, ["a", "b"], ("ridge", "nothing"), train=12, validate=12, step=60)
    why = {(r.model, r.fold_id): r.failed for r in few.collect()}
    assert why["ridge", 0] == "12 training rows; at least 20 are needed" and why["ridge", 1] is None and why["nothing", 1] == "no model is called nothing"


def test_models_as_tables(spark, tmp_path):
    data = _design(spark).withColumn("k", F.lit("all"))
    model = learners.coefficients(data, ["a", "b"], "ridge", ("k",)).drop("k")
    learners.save(model, str(tmp_path / "m"), kind="ridge")
    back, manifest = learners.load(spark, str(tmp_path / "m"))
    assert manifest["kind"] == "ridge" and manifest["features"] == ["a", "b", "intercept"]
    long = data.unpivot(["period"], ["a", "b"], "feature", "value")
    said = learners.predict(long, back).toPandas().sort_values("period")["predicted"].to_numpy()
    frame = data.toPandas().sort_values("period")
    assert said == pytest.approx(learners.answer("ridge", frame, frame, ["a", "b"], "standard"))
    parts = learners.contributions(data, ["a", "b"], "ridge").groupBy("period").agg(F.sum("value").alias("s")).toPandas().sort_values("period")["s"].to_numpy()
    assert parts == pytest.approx(said - said.mean())
    panel = long.withColumnRenamed("feature", "series")
    assert [r.rank for r in learners.monitoring(learners.contributions(data, ["a", "b"], "ridge"), panel, 1).collect()] == [1]


def test_classifier(spark):
    out = learners.classify(_design(spark), ["a", "b"], "1998-01-01").collect()
    assert np.mean([(r.actual > 0) == r.bullish for r in out]) > 0.8 and all(0 <= r.probability <= 1 for r in out)


def test_linkage_cut_and_clusters():
    d = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.9, 0.9], [0.9, 0.9, 0, 0.2], [0.8, 0.9, 0.2, 0]])
    assert stats.average_linkage(list("abcd"), d, 1, 0.15) == [1, 1, 2, 3] and stats.average_linkage(list("abcd"), d, 1, 0.5) == [1, 1, 2, 2]


def test_nested_ranks_inside_the_training_span(spark):
    data = _design(spark, 200)
    inner = dict(train=36, validate=12, step=12)
    got = learners.nested(data, ["a", "b"], ("vecm", "ridge"), 2, 100, 24, 1, "standard", **inner).toPandas()
    frame = data.toPandas().sort_values("period")
    for k, (end, start, stop) in enumerate(align.outer_folds(frame["period"].min(), frame["period"].max(), 2, 100, 24)):
        train, held = frame[frame["period"] <= end], frame[(frame["period"] >= start) & (frame["period"] <= stop)]
        mine = got[got["fold_id"] == k].sort_values("period")
        assert set(mine["chosen"]) == {"ridge"} and mine["predicted"].to_numpy() == pytest.approx(learners.answer("ridge", train, held, ["a", "b"], "standard"))
    noisy = frame.copy()
    noisy.loc[noisy["period"] > end, "y"] = 1e6
    again = learners.rank_models(noisy[noisy["period"] <= end], ["a", "b"], ("vecm", "ridge"), "standard", **inner)
    assert again == learners.rank_models(frame[frame["period"] <= end], ["a", "b"], ("vecm", "ridge"), "standard", **inner)
