"""Learners that fit one fold and model in a task: the frozen preparation, linear, neural and error-correction kernels.

A tournament is one grouped job: rows meet their folds by a join with the few fold bounds, models are exploded, and each
(model, fold) is fitted on its training rows by numpy and answers its validation rows. Nothing is collected, and no fold
waits for another. A fold is small by nature: one row a period."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidalpanel.functions import windows as w
from tidalpanel.operators import align, evaluation, stats
from tidalpanel.operators.models import LEAST_ROWS

SEED = 42
#: Series that an error-correction system holds beside its target, and rows that each lag of each needs.
VECM_SERIES = 3
VECM_ROWS = 5
MLP = {"hidden": (16, 8), "epochs": 200, "rate": 0.01}


# ---- preparation


@dataclass
class Prepared:
    """What was learned from training rows: the columns kept, their fills, centres and spreads."""

    names: list[str]
    fill: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def apply(self, rows: pd.DataFrame) -> np.ndarray:
        x = rows.reindex(columns=self.names).to_numpy(float)
        return (np.where(np.isnan(x), self.fill, x) - self.centre) / self.spread


def prepare(train: pd.DataFrame, names: list[str], how: str = "robust", spare: int = 20) -> tuple[Prepared, np.ndarray]:
    """The frozen preparation and the training matrix.

    Columns without values or without variance go, then those with most gaps and least variance beyond rows - spare. Training
    gaps take the median of the values before them (none: 0); validation gaps the last such median. Scaling is by
    median and interquartile range, or mean and deviation; a spread of zero counts as one."""
    x = train[names].astype(float)
    x = x.loc[:, (x.notna().any()) & (x.var() > 0)]
    order = sorted(x.columns, key=lambda c: (x[c].isna().sum(), -x[c].var(), c))
    kept = order[: max(1, len(x) - spare)]
    x = x[[c for c in names if c in set(kept)]]
    before = x.expanding().median().shift(1).fillna(0.0)
    filled = x.fillna(before)
    if how == "robust":
        centre, spread = filled.median(), filled.quantile(0.75) - filled.quantile(0.25)
    else:
        centre, spread = filled.mean(), filled.std(ddof=0)
    spread = spread.where(spread != 0, 1.0)
    out = Prepared(list(x.columns), x.median().fillna(0.0).to_numpy(), centre.to_numpy(), spread.to_numpy())
    return out, (filled.to_numpy() - out.centre) / out.spread


# ---- kernels: (x, y) -> a function of a matrix


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise RSS + alpha * |w|^2."""
    mean = x.mean(axis=0)
    c = x - mean
    b = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ (y - y.mean()))
    return b, float(y.mean() - mean @ b)


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float = 1e-4, ratio: float = 0.5, rounds: int = 5000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Minimises RSS / 2n + alpha * (ratio * |w| + (1 - ratio) / 2 * |w|^2) by coordinate descent."""
    n, mean = len(x), x.mean(axis=0)
    c, b = x - mean, np.zeros(x.shape[1])
    rest, size = y - y.mean(), (c * c).sum(axis=0) / n
    for _ in range(rounds):
        moved = 0.0
        for j in range(x.shape[1]):
            if size[j] == 0:
                continue
            pull = c[:, j] @ rest / n + size[j] * b[j]
            new = np.sign(pull) * max(0.0, abs(pull) - alpha * ratio) / (size[j] + alpha * (1 - ratio))
            if new != b[j]:
                rest -= c[:, j] * (new - b[j])
                moved, b[j] = max(moved, abs(new - b[j])), new
        if moved < tol:
            break
    return b, float(y.mean() - mean @ b)


def lasso(x: np.ndarray, y: np.ndarray, alpha: float = 1e-4) -> tuple[np.ndarray, float]:
    return elastic_net(x, y, alpha, 1.0)


LINEAR = {"ridge": ridge, "lasso": lasso, "elastic_net": elastic_net}


def mlp(x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...] = MLP["hidden"], epochs: int = MLP["epochs"], rate: float = MLP["rate"], seed: int = SEED):
    """A network of linear and ReLU layers, fitted to squared errors by Adam on all rows; y is standardised inside."""
    rng, centre, spread = np.random.default_rng(seed), y.mean(), y.std() or 1.0
    sizes = [x.shape[1], *hidden, 1]
    params = [p for a, b in zip(sizes, sizes[1:]) for p in (rng.standard_normal((a, b)) * np.sqrt(2 / a), np.zeros(b))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    goal = ((y - centre) / spread)[:, None]

    def forward(rows: np.ndarray) -> list[np.ndarray]:
        layers = [rows]
        for k in range(0, len(params), 2):
            out = layers[-1] @ params[k] + params[k + 1]
            layers.append(np.maximum(out, 0) if k + 2 < len(params) else out)
        return layers

    for step in range(1, epochs + 1):
        layers = forward(x)
        slope, grads = 2 * (layers[-1] - goal) / len(x), [None] * len(params)
        for k in reversed(range(0, len(params), 2)):
            grads[k], grads[k + 1] = layers[k // 2].T @ slope, slope.sum(axis=0)
            slope = (slope @ params[k].T) * (layers[k // 2] > 0)
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return lambda rows: forward(rows)[-1][:, 0] * spread + centre


def vecm(x: np.ndarray, y: np.ndarray, steps: int, lags: int = 12) -> np.ndarray:
    """Forecasts of y by an error-correction system of rank one with the series most correlated with it, run forward on its
    own answers; zeros when it cannot be fitted."""
    try:
        score = [abs(np.corrcoef(x[:, j], y)[0, 1]) if x[:, j].std() > 0 and y.std() > 0 else 0.0 for j in range(x.shape[1])]
        chosen = sorted(range(x.shape[1]), key=lambda j: (-score[j], j))[:VECM_SERIES]
        z = np.column_stack([x[:, chosen], y])
        n, k = z.shape
        lags = min(lags, max(1, int(n / (VECM_ROWS * k))))
        if n < lags + 10:
            return np.zeros(steps)
        d = np.diff(z, axis=0)
        now, level = d[lags:], z[lags:-1]
        past = np.column_stack([d[lags - i : len(d) - i] for i in range(1, lags + 1)])
        clean = lambda m: m - past @ np.linalg.lstsq(past, m, rcond=None)[0]
        r0, r1 = clean(now), clean(level)
        s00, s11, s01 = r0.T @ r0, r1.T @ r1, r0.T @ r1
        values, vectors = np.linalg.eig(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01)))
        beta = vectors.real[:, np.argmax(values.real)]
        design = np.column_stack([level @ beta, past])
        weight = np.linalg.lstsq(design, now, rcond=None)[0]
        history, out = list(z[-lags - 1 :]), []
        for _ in range(steps):
            moves = [history[-i] - history[-i - 1] for i in range(1, lags + 1)]
            history.append(history[-1] + np.concatenate([[history[-1] @ beta], *moves]) @ weight)
            out.append(history[-1][-1])
        return np.array(out) if np.isfinite(out).all() else np.zeros(steps)
    except np.linalg.LinAlgError:
        return np.zeros(steps)


def answer(model: str, train: pd.DataFrame, validate: pd.DataFrame, names: list[str], how: str = "robust") -> np.ndarray:
    """Forecasts for the validation rows by a model fitted, after preparation, on the training rows."""
    prepared, x = prepare(train, names, how)
    y = train["y"].to_numpy(float)
    if model == "vecm":
        return vecm(x, y, len(validate))
    rows = prepared.apply(validate)
    if model == "mlp":
        return mlp(x, y)(rows)
    if model not in LINEAR:
        raise ValueError(f"no model is called {model}")
    b, intercept = LINEAR[model](x, y)
    return rows @ b + intercept


# ---- grouped jobs


def tournament(data: DataFrame, names: list[str], models: tuple[str, ...] = ("ridge", "lasso"), how: str = "robust", **fold_options) -> DataFrame:
    """data (period, names, y) -> forecasts (model, fold_id, period, actual, predicted, failed) of all folds' validation rows.

    A model that fails on a fold, or has fewer than LEAST_ROWS training rows, leaves null forecasts there and `failed`
    tells why; other folds stand."""
    rows = data.select("period", "y", *names).filter("y is not null")
    bounds = align.folds(rows, **fold_options)
    each = align.fold_rows(rows, bounds).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("period")
        train, validate = group[group["part"] == "train"], group[group["part"] == "validate"]
        failed = None
        try:
            if len(train) < LEAST_ROWS:
                raise ValueError(f"{len(train)} training rows; at least {LEAST_ROWS} are needed")
            found = answer(key[0], train, validate, names, how)
        except (ValueError, np.linalg.LinAlgError) as error:
            found, failed = np.full(len(validate), np.nan), str(error)
        predicted = [None if not np.isfinite(v) else float(v) for v in found]
        return pd.DataFrame({"model": key[0], "fold_id": key[1], "period": validate["period"], "actual": validate["y"], "predicted": predicted, "failed": failed})

    return each.groupBy("model", "fold_id").applyInPandas(run, "model string, fold_id int, period date, actual double, predicted double, failed string")


def _rank_correlation(actual: np.ndarray, predicted: np.ndarray) -> float:
    """Of average ranks; 0 for a constant side, nan for fewer than three rows."""
    if len(actual) < 3:
        return float("nan")
    a, p = pd.Series(actual).rank().to_numpy(), pd.Series(predicted).rank().to_numpy()
    return float(np.corrcoef(a, p)[0, 1]) if a.std() > 0 and p.std() > 0 else 0.0


def rank_models(train: pd.DataFrame, names: list[str], candidates: tuple[str, ...], how: str, /, **fold_options) -> list[str]:
    """Candidates by their mean IC over the inner folds of the training rows, best first; those that fail everywhere come last."""
    scores = {}
    for model in candidates:
        ics = []
        for _, start, end, val_start, val_end in align.fold_bounds(train["period"].min(), train["period"].max(), **fold_options):
            inside, validate = train[train["period"].between(start, end)], train[train["period"].between(val_start, val_end)]
            if len(inside) < LEAST_ROWS or validate.empty:
                continue
            try:
                ics.append(_rank_correlation(validate["y"].to_numpy(float), answer(model, inside, validate, names, how)))
            except (ValueError, np.linalg.LinAlgError):
                continue
        known = [x for x in ics if np.isfinite(x)]
        scores[model] = np.mean(known) if known else -np.inf
    return sorted(candidates, key=lambda m: (-scores[m], m))


def nested(data: DataFrame, names: list[str], candidates: tuple[str, ...], outer: int = 3, least: int = 120, test: int = 24, keep: int = 2, how: str = "robust", **inner) -> DataFrame:
    """(fold_id, period, actual, predicted, chosen): models are ranked inside each outer training span only; the best `keep` are
    averaged over its test span. One grouped job; an outer fold needs more than 20 training and 5 test rows."""
    rows = data.select("period", "y", *names).filter("y is not null")
    first, last = rows.agg(F.min("period"), F.max("period")).first()
    bounds = [(k, first, end, start, stop) for k, (end, start, stop) in enumerate(align.outer_folds(first, last, outer, least, test))] if first else []
    bounds = data.sparkSession.createDataFrame(bounds, "fold_id int, train_start date, train_end date, val_start date, val_end date")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("period")
        train, held = group[group["part"] == "train"], group[group["part"] == "validate"]
        if len(train) <= 20 or len(held) <= 5:
            return pd.DataFrame(columns=["fold_id", "period", "actual", "predicted", "chosen"])
        best = rank_models(train, names, candidates, how, **inner)[:keep]
        said = np.mean([answer(m, train, held, names, how) for m in best], axis=0)
        return pd.DataFrame({"fold_id": key[0], "period": held["period"], "actual": held["y"], "predicted": said, "chosen": ",".join(best)})

    return align.fold_rows(rows, bounds).groupBy("fold_id").applyInPandas(run, "fold_id int, period date, actual double, predicted double, chosen string")


def leaderboard(forecasts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per model over its folds: mean and deviation of IC, RMSE, hit rate, the mean IC's t statistic and p-value, and whether it is significant."""
    ic = evaluation.information_coefficient(evaluation.complete(forecasts), "model", "fold_id").drop("n")
    folds = evaluation.metrics(forecasts, "model", "fold_id").join(ic, ["model", "fold_id"])
    out = folds.groupBy("model").agg(
        F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_sd"), F.stddev_samp("ic").alias("s"), F.avg("rmse").alias("rmse"), F.avg("hit_rate").alias("hit_rate"), F.count("ic").alias("folds")
    )
    out = out.withColumn("t_stat", F.col("ic_mean") / w.nonzero(F.col("s") / F.sqrt("folds"))).drop("s")
    out = out.withColumn("p_value", stats.t_p_value("t_stat", F.greatest(F.lit(1.0), F.col("folds") - 1.0)))
    rank = F.row_number().over(Window.orderBy(F.desc("ic_mean"), "model"))
    return out.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False))).withColumn("rank", rank)


def coefficients(data: DataFrame, names: list[str], model: str, keys: tuple[str, ...], how: str = "standard", **options) -> DataFrame:
    """(keys, feature, coefficient, centre, spread, fill, n): one row a feature that was kept and one for the intercept; a model as a table."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("period")
        prepared, x = prepare(rows, names, how)
        b, intercept = LINEAR[model](x, rows["y"].to_numpy(float), **options)
        out = pd.DataFrame({"feature": [*prepared.names], "coefficient": b, "centre": prepared.centre, "spread": prepared.spread, "fill": prepared.fill})
        out = pd.concat([out, pd.DataFrame({"feature": ["intercept"], "coefficient": [intercept], "centre": [0.0], "spread": [1.0], "fill": [0.0]})])
        for k in keys:
            out[k] = rows[k].iloc[0]
        return out.assign(n=len(rows))[[*keys, "feature", "coefficient", "centre", "spread", "fill", "n"]]

    kinds = ", ".join(f"{k} {data.schema[k].dataType.simpleString()}" for k in keys)
    out = data.groupBy(*keys).applyInPandas(run, f"{kinds}, feature string, coefficient double, centre double, spread double, fill double, n long")
    return out if len(names) > 1 else out.filter("feature <> 'intercept'")


def predict(features: DataFrame, model: DataFrame, *keys: str) -> DataFrame:
    """features (keys, period, feature, value) answered by a model table: a join and a sum; an absent feature counts as its fill."""
    rows = features.select(*keys, "period").distinct()
    grid = rows.join(model.select("feature", "coefficient", "centre", "spread", "fill"), F.lit(True))
    met = grid.join(features, [*keys, "period", "feature"], "left")
    term = F.when(F.col("feature") == "intercept", F.col("coefficient")).otherwise(F.col("coefficient") * (F.coalesce("value", "fill") - F.col("centre")) / F.col("spread"))
    return met.groupBy(*keys, "period").agg(F.sum(term).alias("predicted"))


def save(model: DataFrame, path: str, **about) -> None:
    """A model table and its manifest, by Spark's committed writers."""
    model.write.mode("overwrite").parquet(f"{path}/model")
    manifest = json.dumps({"features": sorted(r["feature"] for r in model.select("feature").collect()), **about}, sort_keys=True)
    model.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The model table and the manifest; a manifest that names other features is an error."""
    model = spark.read.parquet(f"{path}/model")
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    found = sorted(r["feature"] for r in model.select("feature").collect())
    if found != manifest["features"]:
        raise ValueError(f"the manifest of {path} does not name the model's features")
    return model, manifest


def contributions(data: DataFrame, names: list[str], model: str, how: str = "standard") -> DataFrame:
    """(period, feature, value): a feature's part in a linear model's forecast, its coefficient times the distance from the training mean."""
    rows = data.select(F.lit("all").alias("k"), "period", "y", *names).dropna(subset=["y", *names])
    table = coefficients(rows, names, model, ("k",), how).filter("feature <> 'intercept'").select("feature", "coefficient", "spread")
    long = rows.unpivot(["period"], names, "feature", "value")
    means = long.groupBy("feature").agg(F.avg("value").alias("mean"))
    return long.join(means, "feature").join(table, "feature").select("period", "feature", (F.col("coefficient") / F.col("spread") * (F.col("value") - F.col("mean"))).alias("value"))


def monitoring(contributed: DataFrame, panel: DataFrame, top: int = 10) -> DataFrame:
    """(feature, mean_abs, rank, current, percentile, signal) of the strongest features: what to watch."""
    strength = contributed.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    strength = strength.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature"))).filter(F.col("rank") <= top)
    return strength.join(evaluation.percentile_signal(panel).withColumnRenamed("series", "feature"), "feature", "left")


def classify(data: DataFrame, names: list[str], before: str, trees: int = 50, depth: int = 3) -> DataFrame:
    """(period, actual, probability, bullish) from `before` on: a forest's probability that y is above zero, fitted on earlier periods; gaps count as 0."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = data.filter("y is not null").fillna(0.0, subset=names).withColumn("label", (F.col("y") > 0).cast("double"))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    fitted = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED).fit(rows.filter(F.col("period") < F.lit(before).cast("date")))
    out = fitted.transform(rows.filter(F.col("period") >= F.lit(before).cast("date")))
    return out.select("period", F.col("y").alias("actual"), vector_to_array("probability")[1].alias("probability"), (F.col("prediction") == 1).alias("bullish"))


def vintage_loop(vintages: DataFrame, names: tuple[str, ...], target: str, model: DataFrame | None = None) -> DataFrame:
    """(vintage, forecast, realised): what a frozen model said of the target's next change with each vintage's own scores.

    Without a model, ridge is fitted on the first vintage's history, and that vintage is not forecast."""
    v = F.col("value")
    scored = vintages.withColumn("z", w.zscore(v, w.expanding("vintage", "series"))).withColumn("y", F.lead("value").over(w.by_series("vintage", "series")) - v)
    first = vintages.agg(F.min("vintage")).first()[0]
    goal = scored.filter(F.col("series") == target).select("vintage", "period", "y")
    if model is None:
        rows = scored.filter(F.col("vintage") == F.lit(first)).groupBy("period").pivot("series", list(names)).agg(F.first("z"))
        rows = rows.join(goal.filter(F.col("vintage") == F.lit(first)).select("period", "y"), "period").filter("y is not null").withColumn("k", F.lit("all"))
        model = coefficients(rows, list(names), "ridge", ("k",))
        vintages = vintages.filter(F.col("vintage") > F.lit(first))
    last = scored.filter("z is not null").groupBy("vintage", "series").agg(F.max_by("z", "period").alias("value"))
    last = last.join(vintages.select("vintage").distinct(), "vintage", "left_semi")
    features = last.select("vintage", F.col("vintage").alias("period"), F.col("series").alias("feature"), "value")
    said = predict(features, model, "vintage").select("vintage", F.col("predicted").alias("forecast"))
    final = goal.groupBy("period").agg(F.max_by("y", F.struct("vintage")).alias("realised"))
    return said.join(final, F.col("vintage") == F.col("period"), "left").select("vintage", "forecast", "realised")
