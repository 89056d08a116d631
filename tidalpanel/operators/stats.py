"""Time-series tests that need matrix algebra: pure numpy kernels, run one series or pair a task."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Published critical values at 1, 5 and 10 percent (constant, large samples).
ADF_CRITICAL = (-3.430, -2.862, -2.567)
ENGLE_GRANGER_CRITICAL = (-3.900, -3.338, -3.046)
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
#: Trace statistics for two series at 90, 95 and 99 percent: rank 0, rank 1.
JOHANSEN_CRITICAL = ((13.4294, 15.4943, 19.9349), (2.7055, 3.8415, 6.6349))
LEAST = 20


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, their standard errors and residuals."""
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    s2 = e @ e / max(1, len(y) - x.shape[1])
    return b, np.sqrt(np.maximum(0, np.diag(s2 * np.linalg.pinv(x.T @ x)))), e


def adf(v: np.ndarray, constant: bool = True) -> tuple[float, int]:
    """The t statistic of the level, with the number of lags that minimises AIC over one sample."""
    n = len(v)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    d, best = np.diff(v), None
    for lags in range(max(0, most) + 1):
        start = most
        y = d[start:]
        x = [v[start:-1]] + [d[start - k : len(d) - k] for k in range(1, lags + 1)]
        if constant:
            x.append(np.ones(len(y)))
        x = np.column_stack(x)
        b, se, e = ols(y, x)
        aic = len(y) * math.log(max(1e-300, e @ e / len(y))) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lags)
    lags = best[1]
    y = d[lags:]
    x = [v[lags:-1]] + [d[lags - k : len(d) - k] for k in range(1, lags + 1)] + ([np.ones(len(y))] if constant else [])
    b, se, _ = ols(y, np.column_stack(x))
    return float(b[0] / se[0]) if se[0] > 0 else float("nan"), lags


def from_critical(stat: float, critical: tuple[float, float, float]) -> float:
    """A p-value by interpolation of log p between the critical values, kept within 0.001 and 0.999."""
    if not math.isfinite(stat):
        return 1.0
    x, p = np.array(critical), np.log([0.01, 0.05, 0.10])
    k = 0 if stat < x[1] else 1
    slope = (p[k + 1] - p[k]) / (x[k + 1] - x[k])
    return float(min(0.999, max(0.001, math.exp(p[k] + slope * (stat - x[k])))))


def kpss(v: np.ndarray) -> tuple[float, float]:
    """Level statistic with automatic lags, and its p-value clipped to the table."""
    n, e = len(v), v - v.mean()
    lags = min(n - 1, int(math.ceil(12 * (n / 100) ** 0.25)))
    s2 = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / s2) if s2 > 0 else float("nan")
    return stat, float(np.interp(stat, [c for c, _ in KPSS_CRITICAL], [p for _, p in KPSS_CRITICAL])) if math.isfinite(stat) else 0.0


def half_life(e: np.ndarray) -> float:
    rho = np.corrcoef(e[1:], e[:-1])[0, 1]
    return float(-math.log(2) / math.log(rho)) if 0 < rho < 1 else float("nan")


def johansen(a: np.ndarray, b: np.ndarray, lags: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Trace statistics for ranks 0 and 1, and the first vector with its first element 1."""
    z = np.column_stack([a, b])
    d = np.diff(z, axis=0)
    y, level = d[lags:], z[lags:-1]
    x = np.column_stack([d[lags - k : len(d) - k] for k in range(1, lags + 1)] + [np.ones(len(y))])
    clean = lambda m: m - x @ np.linalg.lstsq(x, m, rcond=None)[0]
    r0, r1 = clean(y), clean(level)
    n = len(y)
    s00, s11, s01 = r0.T @ r0 / n, r1.T @ r1 / n, r0.T @ r1 / n
    values, vectors = np.linalg.eig(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01)))
    order = np.argsort(-values.real)
    values, vector = np.clip(values.real[order], 0, 1 - 1e-12), vectors.real[:, order[0]]
    trace = np.array([-n * np.log(1 - values[k:]).sum() for k in range(2)])
    return trace, vector / vector[0] if vector[0] else vector


def stationarity(panel: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(series, n, adf, adf_p, kpss, kpss_p, advice), one task a series."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("period")["value"].dropna().to_numpy(float)
        if len(v) < LEAST or np.ptp(v) == 0:
            return pd.DataFrame({"series": [rows["series"].iloc[0]], "n": [len(v)], "adf": [np.nan], "adf_p": [1.0], "kpss": [np.nan], "kpss_p": [0.0]})
        t, k = adf(v)[0], kpss(v)
        return pd.DataFrame({"series": [rows["series"].iloc[0]], "n": [len(v)], "adf": [t], "adf_p": [from_critical(t, ADF_CRITICAL)], "kpss": [k[0]], "kpss_p": [k[1]]})

    out = panel.groupBy("series").applyInPandas(run, "series string, n long, adf double, adf_p double, kpss double, kpss_p double")
    a, k = F.col("adf_p") < alpha, F.col("kpss_p") >= alpha
    return out.withColumn("advice", advice(a, k))


def advice(adf_stationary, kpss_stationary):
    """The four cells of the two tests; both arguments are boolean columns."""
    both = F.when(adf_stationary & kpss_stationary, "stationary").when(adf_stationary, "trend stationary")
    return both.when(kpss_stationary, "difference stationary").otherwise("non-stationary")


def cointegration(panel: DataFrame, pairs: DataFrame, least: int = 60, alpha: float = 0.05, lags: int = 2) -> DataFrame:
    """pairs (name, a, b) -> tests, vector and validation of each; one task a pair."""
    x = panel.filter("value is not null").select("period", F.col("series").alias("a"), F.col("value").alias("va"))
    y = panel.filter("value is not null").select("period", F.col("series").alias("b"), F.col("value").alias("vb"))
    both = x.join(F.broadcast(pairs), "a").join(y, ["period", "b"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("period")
        a, b = rows["va"].to_numpy(float), rows["vb"].to_numpy(float)
        out = {"name": rows["name"].iloc[0], "n": len(a), "trace0": np.nan, "rank": 0, "beta": np.nan, "eg": np.nan, "eg_p": 1.0, "half_life": np.nan, "valid": False}
        if len(a) >= max(least, LEAST) and np.ptp(a) > 0 and np.ptp(b) > 0:
            trace, vector = johansen(a, b, lags)
            rank = int(trace[0] > JOHANSEN_CRITICAL[0][1]) + int(trace[0] > JOHANSEN_CRITICAL[0][1] and trace[1] > JOHANSEN_CRITICAL[1][1])
            e = ols(a, np.column_stack([b, np.ones(len(b))]))[2]
            t = adf(e, False)[0]
            p = from_critical(t, ENGLE_GRANGER_CRITICAL)
            out |= {"trace0": trace[0], "rank": rank, "beta": -vector[1], "eg": t, "eg_p": p, "half_life": half_life(e), "valid": bool(rank >= 1 or p < alpha)}
        return pd.DataFrame([out])

    return both.groupBy("name").applyInPandas(run, "name string, n long, trace0 double, rank int, beta double, eg double, eg_p double, half_life double, valid boolean")


# Prior weights of theories.
PRIORS = {
    "consumption_income": 0.8, "fisher_hypothesis": 0.6, "yields_inflation": 0.6, "quantity_theory": 0.5, "gdp_m2": 0.5, "income_m2": 0.5,
    "okun_law": 0.4, "output_employment": 0.4, "housing_rates": 0.3, "permits_rates": 0.3, "stocks_gdp": 0.2,
}
#: Weight from which a pair enters the model, and rows beyond a window that its stability needs.
LEAST_WEIGHT = 0.3
SPARE_ROWS = 24
#: What stands for the p-value of a trace test that rejects, and of one that does not.
JOHANSEN_P = (0.01, 0.5)


def evidence(p, how: str = "logistic"):
    """How much a p-value speaks for a pair: logistic about 0.10, or falling to 0 at 0.2; a missing one does not."""
    out = 1 / (1 + F.exp(10 * (p - 0.10))) if how == "logistic" else F.greatest(F.lit(0.0), 1 - p / 0.2)
    return F.coalesce(out, F.lit(0.0))


def steadiness(share):
    """Factor of the share of windows that reject; 1 where stability was not asked for."""
    return F.when(share.isNull(), 1.0).when(share >= 0.5, 0.8 + 0.2 * (share - 0.5) / 0.5).otherwise(0.8 * share / 0.5)


def pair_weight(name, johansen_p, p, factor, how: str = "logistic"):
    """prior^.3 * evidence^.5 * steadiness^.2 with the smaller p-value as evidence; all arguments are columns, factor is that of steadiness()."""
    prior = F.lit(0.5)
    for theory, weight in PRIORS.items():
        prior = F.when(name == theory, weight).otherwise(prior)
    return F.pow(prior, F.lit(0.3)) * F.pow(evidence(F.least(johansen_p, p), how), F.lit(0.5)) * F.pow(factor, F.lit(0.2))


def weighted(tests: DataFrame, stability: DataFrame | None = None) -> DataFrame:
    """cointegration() results with weight and included; stability is that of rolling_stability()."""
    rows = tests if stability is None else tests.join(stability.select("name", "factor"), "name", "left")
    factor = F.lit(1.0) if stability is None else F.coalesce("factor", F.lit(0.5))
    johansen_p = F.when(F.col("rank") >= 1, JOHANSEN_P[0]).otherwise(JOHANSEN_P[1])
    rows = rows.withColumn("weight", pair_weight(F.col("name"), johansen_p, F.coalesce(F.when(F.isnan("eg"), None).otherwise(F.col("eg_p")), F.lit(0.5)), factor))
    return rows.withColumn("included", F.col("weight") >= LEAST_WEIGHT)


def average_linkage(names: list[str], distance: np.ndarray, clusters: int = 1, farthest: float = float("inf")) -> list[int]:
    """Cluster numbers after merging the closest groups, by mean distance, until `clusters` are left or the next merge is beyond `farthest`."""
    groups = {i: [i] for i in range(len(names))}
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while len(groups) > max(1, clusters):
        keys = sorted(groups)
        part = d[np.ix_(keys, keys)]
        if part.min() > farthest:
            break
        i, j = sorted(keys[k] for k in np.unravel_index(np.argmin(part), part.shape))
        ni, nj = len(groups[i]), len(groups[j])
        d[i] = d[:, i] = (ni * d[i] + nj * d[j]) / (ni + nj)
        d[i, i] = np.inf
        groups[i] += groups.pop(j)
    out = [0] * len(names)
    for number, key in enumerate(sorted(groups, key=lambda k: min(groups[k]))):
        for member in groups[key]:
            out[member] = number + 1
    return out


def clusters(matrix: DataFrame, n: int | None = None, similarity: float | None = None, most: int = 2000) -> DataFrame:
    """matrix (a, b, distance) of features -> (feature, cluster, representative): n clusters, or those that a cut at
    distance 1 - similarity leaves. The features of a model are few; more than `most` is an error rather than a silent collect."""
    names = [r["a"] for r in matrix.select("a").union(matrix.select("b")).distinct().orderBy("a").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} features to cluster")
    place = {name: i for i, name in enumerate(names)}
    d = np.ones((len(names), len(names)))
    for r in matrix.select("a", "b", "distance").collect():
        d[place[r["a"]], place[r["b"]]] = d[place[r["b"]], place[r["a"]]] = r["distance"]
    number = average_linkage(names, d, n or 1, 1 - similarity if similarity is not None else float("inf"))
    rows = []
    for k in sorted(set(number)):
        members = [i for i, x in enumerate(number) if x == k]
        middle = min(members, key=lambda i: (d[i, members].sum() - d[i, i], names[i]))
        rows += [(names[i], k, names[middle]) for i in members]
    return matrix.sparkSession.createDataFrame(rows, "feature string, cluster int, representative string")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)) if abs(1 - (a + b) * x / (a + 1)) > 1e-300 else 1e300
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The value below which Student's t falls with probability p, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - t_two_sided(middle, df) / 2 < p else (low, middle)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-values; null where either argument is."""
    return pd.Series([None if pd.isna(a) or pd.isna(d) else t_two_sided(float(a), float(d)) for a, d in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(d) else t_quantile(float(a), float(d)) for a, d in zip(p, df)], dtype="float64")
