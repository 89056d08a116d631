"""Windows, transforms and preprocessing on small series with known answers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalpanel.functions import windows as w
from tidalpanel.operators import align, preprocess, transforms
from tidalpanel.plans import panels

V = lambda: F.col("value")


def panel(spark, *series):
    rows = []
    for k, values in enumerate(series):
        rows += [(align.plus_months(dt.date(2000, 1, 1), i), f"s{k}", None if x is None else float(x)) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "period date, series string, value double")


def column(df, name, series="s0"):
    return [r[name] for r in df.filter(F.col("series") == series).orderBy("period").collect()]


@pytest.mark.parametrize("values, last", [([1, 2, 3, 4, 100], 5), ([10, 9, 8, 7, 1], 1), ([*range(1, 16), 14.5], 5)])
def test_quintile_of_the_last_value(spark, values, last):
    assert column(panel(spark, values).withColumn("q", w.quintile(V(), 1)), "q")[-1] == last


def test_quintile_burn_in(spark):
    q = column(preprocess.quintile_features(panel(spark, np.random.default_rng(0).standard_normal(100)), 60), "quintile")
    assert q[:59] == [None] * 59 and q[59] is not None


def test_imputer_and_scalers(spark):
    assert column(preprocess.impute_expanding(panel(spark, [1, 10, None, 2, None])), "value") == [1, 10, 5.5, 2, 2]
    assert column(preprocess.impute_expanding(panel(spark, [None] * 5 + [10.0] * 3)), "value")[0] == 0
    fitted = preprocess.statistics(panel(spark, [1, 2, 3]))
    assert column(preprocess.scale(panel(spark, [10]), fitted), "value")[0] == pytest.approx(8 / np.std([1, 2, 3]))
    got = column(preprocess.scale_expanding(panel(spark, [1, 2, 3, 4, 5]), 2, "null"), "value")
    assert got[:2] == [None, None] and got[2] == pytest.approx(1.5 / np.std([1, 2], ddof=1))


def test_nothing_looks_ahead(spark):
    rng = np.random.default_rng(1)
    x = [None if rng.random() < 0.1 else float(v) for v in rng.standard_normal(50).cumsum()]

    def everything(df):
        out = df.withColumn("z", w.zscore(V(), w.expanding())).withColumn("r", w.robust(V(), w.expanding())).withColumn("p", w.percentile_rank(V())).withColumn("q", w.quintile(V(), 10)).withColumn("d", w.drawdown(V()))
        out = out.withColumn("f", w.forward_fill(V())).join(preprocess.impute_expanding(df).withColumnRenamed("value", "i"), ["period", "series"])
        return [tuple(r) for r in out.orderBy("period").collect()]

    assert everything(panel(spark, x))[:30] == everything(panel(spark, x[:30]))


def test_transforms_by_hand_and_inverse(spark):
    x = [2.0, 4.0, 0.0, -1.0, None, 8.0]
    codes = panel(spark, x).select("series").distinct()
    out = lambda code: column(transforms.transform(panel(spark, x), codes.withColumn("code", F.lit(code))), "out")
    assert out(2) == [None, 2, -4, -1, None, None] and out(3)[2] == -6
    assert out(4) == pytest.approx([math.log(2), math.log(4), None, math.log(1e-10), None, math.log(8)])
    assert out(5)[1] == pytest.approx(math.log(2)) and out(9) == x
    assert out(7) == pytest.approx([None, 1, -1, None, 0, -9])
    positive = panel(spark, [3.0, 5.0, 4.0, 9.0])
    for code in (2, 5, 7):
        coded = transforms.transform(positive, codes.withColumn("code", F.lit(code)))
        assert column(transforms.inverse(coded, code), "back") == pytest.approx([3, 5, 4, 9])


def test_quintile_transformer_outside_the_training_range(spark):
    fitted = preprocess.fit_quintiles(panel(spark, range(1, 11)))
    out = preprocess.apply_quintiles(panel(spark, [0, 1, 5, 10, 11, None]), fitted).orderBy("period").collect()
    assert [tuple(r)[3:] for r in out] == [(0,) * 5, (1, 0, 0, 0, 0), (0, 0, 1, 0, 0), (0, 0, 0, 0, 1), (0,) * 5, (0,) * 5]


def test_densify_and_finite(spark):
    rows = [(dt.date(2000, 1, 1), "a", 1.0), (dt.date(2000, 2, 1), "b", float("nan")), (dt.date(2000, 2, 1), "a", float("inf"))]
    df = panels.densify(panels.finite(spark.createDataFrame(rows, "period date, series string, value double")))
    assert df.count() == 4 and df.filter("value is not null").count() == 1


def test_folds_and_holdout(spark):
    p = panel(spark, range(180))
    bounds = align.fold_bounds(dt.date(2000, 1, 1), dt.date(2014, 12, 1), 60, 12, 12, 3)
    assert all(train_end < val_start and (val_start - train_end).days > 80 for _, _, train_end, val_start, _ in bounds)
    rows = align.fold_rows(p, align.folds(p, train=60, validate=12, step=12, gap=3))
    assert rows.filter("part = 'validate'").groupBy("fold_id").count().agg(F.min("count"), F.max("count")).first()[:] == (12, 12)
    assert align.holdout_start(panel(spark, range(100)), 0.2, 10) == align.plus_months(dt.date(2000, 1, 1), 80)
    with pytest.raises(ValueError):
        align.holdout_start(panel(spark, range(240)), 0.05)
    outer = align.outer_folds(dt.date(2000, 1, 1), dt.date(2014, 12, 31), 3, 60, 24)
    assert len(outer) == 3 and all(end < start for end, start, _ in outer) and outer[0][0] >= dt.date(2005, 1, 1)


def test_as_of_takes_the_latest_known(spark):
    left = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("z", 9, "c")], "key string, at int, tag string")
    right = spark.createDataFrame([("k", 2, 20.0), ("k", 5, 50.0), ("k", 6, 60.0)], "key string, since int, price double")
    got = {r.tag: r.price for r in align.as_of(left, right, ("key",), "at", "since").collect()}
    assert got == {"a": None, "b": 50.0, "c": None}
