"""Estimators from distributed sums: only small matrices reach the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .absorb import MIN_ENTITIES, MIN_OBS, MIN_PERIODS, Fit, fit_many, long_rows


def gram(df: DataFrame, xs: list[str], y: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n in one aggregate."""
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    aggs = [F.sum(w * F.col(xs[i]) * F.col(xs[j])).alias(f"g{i}_{j}") for i, j in pairs]
    aggs += [F.sum(w * F.col(x) * F.col(y)).alias(f"b{i}") for i, x in enumerate(xs)]
    row = df.agg(*aggs, F.sum(w * F.col(y) * F.col(y)).alias("yy"), F.count(F.lit(1)).alias("n")).first()
    g = np.zeros((len(xs), len(xs)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g, np.array([row[f"b{i}"] or 0.0 for i in range(len(xs))]), row["yy"] or 0.0, row["n"]


def fit_two_way(df: DataFrame, y: str, xs: list[str], name: str = "", entity: str = "ticker", time: str = "week", cluster_time: bool = True, gates=(MIN_OBS, MIN_ENTITIES, MIN_PERIODS)) -> Fit:
    """Entity and time fixed effects, absorbed exactly; errors clustered by entity (and time)."""
    xs = list(dict.fromkeys(xs))
    return fit_many(long_rows(df, [y, *xs], entity, time), {0: (name, xs)}, gates, cluster_time)[0]


def fits_table(spark, fits: list[Fit]) -> DataFrame:
    """Long table: one row per model and coefficient (or one per model without)."""
    rows = [(f.name, f.status, f.n_obs, f.n_entities, f.n_periods, x, f.params.get(x), f.stderr.get(x), (f.t(x) if x and f.stderr.get(x) else None), f.r2_within, f.note) for f in fits for x in (f.params or {None: None})]
    return spark.createDataFrame(rows, "model string, status string, n_obs long, n_entities long, n_periods long, term string, beta double, se double, t double, r2_within double, note string")


def slopes(df: DataFrame, y: str, x: str, group: list[str], least: int = 20) -> DataFrame:
    """Univariate least squares per group."""
    ok = df.dropna(subset=[y, x]).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return ok.where(F.col("n") >= least)


def newey_west(series: DataFrame, x: str, order: str, lags: int = 4, group: list[str] | None = None) -> DataFrame:
    """Mean of a series with its Bartlett-weighted standard error and t.

    Autocovariances are lag self-products in one window pass; a group is one series
    (one row a period).
    """
    g = group or []
    keyed = series.where(F.col(x).isNotNull()).select(*g, F.col(order), F.col(x).cast("double").alias("__x"))
    keyed = keyed.withColumn("__e", F.col("__x") - F.avg("__x").over(Window.partitionBy(*g)))
    w = Window.partitionBy(*g).orderBy(order)
    e = F.col("__e")
    terms = keyed.withColumns({f"__c{k}": e * (F.lag("__e", k).over(w) if k else e) for k in range(lags + 1)})
    out = terms.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.avg("__x").alias("mean"), *[F.coalesce(F.sum(f"__c{k}"), F.lit(0.0)).alias(f"__s{k}") for k in range(lags + 1)])
    var = F.col("__s0")
    for k in range(1, lags + 1):
        var = var + 2 * (1 - k / (lags + 1)) * F.col(f"__s{k}")
    out = out.withColumn("se", F.sqrt(F.greatest(var, F.lit(0.0))) / F.col("n"))
    return out.select(*g, "n", "mean", "se", F.try_divide("mean", F.nullif(F.col("se"), F.lit(0.0))).alias("t"))


def fama_macbeth(df: DataFrame, y: str, xs: list[str], time: str = "week", least: int = 20, lags: int = 4, least_weeks: int = 10) -> DataFrame:
    """Per-period regressions, averaged, with Newey-West errors.

    One regressor uses the native slope; several use Gram sums per period solved in Arrow
    batches (k x k each).
    """
    if len(xs) == 1:
        per = slopes(df, y, xs[0], [time], least).select(time, F.lit(xs[0]).alias("term"), F.col("slope").alias("beta"))
    else:
        cols, k = ["__one", *xs], len(xs) + 1
        d = df.dropna(subset=[y, *xs]).withColumn("__one", F.lit(1.0))
        sums = d.groupBy(time).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in cols for b in cols]).alias("g"), F.array(*[F.sum(F.col(a) * F.col(y)) for a in cols]).alias("b")).where(F.col("n") >= least)

        def solve(batches):
            import pandas as pd

            for pdf in batches:
                g, b = np.stack(pdf["g"]).reshape(-1, k, k), np.stack(pdf["b"])
                beta = np.einsum("nij,nj->ni", np.linalg.pinv(g, hermitian=True), b)[:, 1:]
                yield pd.DataFrame({time: np.repeat(pdf[time].to_numpy(), k - 1), "term": np.tile(xs, len(pdf)), "beta": beta.reshape(-1)})

        per = sums.mapInPandas(solve, f"{time} {dict(df.dtypes)[time]}, term string, beta double")
    return newey_west(per, "beta", time, lags, ["term"]).where(F.col("n") >= least_weeks)


def logit(df: DataFrame, y: str, xs: list[str], rounds: int = 25, tol: float = 1e-9) -> dict:
    """Unpenalised logistic regression by Newton steps on distributed sums.

    ``status`` is FAILED when the steps had not come below ``tol`` after ``rounds`` of them, as
    where the classes can be separated; the numbers are then those of the last step.
    """
    d = df.select(F.col(y).cast("double").alias("__y"), *xs).dropna().withColumn("__one", F.lit(1.0)).cache()
    cols, beta, h, settled = ["__one", *xs], np.zeros(len(xs) + 1), None, False
    try:
        for _ in range(rounds):
            eta = sum((float(b) * F.col(c) for b, c in zip(beta, cols)), F.lit(0.0))
            step = d.withColumn("__p", 1 / (1 + F.exp(-eta))).withColumn("__e", F.col("__y") - F.col("__p"))
            h, grad, *_ = gram(step, cols, "__e", None)
            row = step.agg(*[F.sum(F.col("__p") * (1 - F.col("__p")) * F.col(a) * F.col(b)).alias(f"h{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]).first()
            h = np.array([[row[f"h{i}_{j}"] for j in range(len(cols))] for i in range(len(cols))])
            delta = np.linalg.lstsq(h, grad, rcond=None)[0]
            beta = beta + delta
            if settled := bool(np.abs(delta).max() < tol):
                break
        eta = sum((float(b) * F.col(c) for b, c in zip(beta, cols)), F.lit(0.0))
        ll, n, m = d.agg(F.sum(F.col("__y") * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))), F.count(F.lit(1)), F.avg("__y")).first()
    finally:
        d.unpersist()
    se = np.sqrt(np.diag(np.linalg.pinv(h)))
    null = n * (m * math.log(m) + (1 - m) * math.log(1 - m)) if 0 < m < 1 else float("nan")
    z = beta / se
    return {"status": "OK" if settled else "FAILED", "term": ["const", *xs], "beta": beta.tolist(), "se": se.tolist(), "z": z.tolist(), "p": [math.erfc(abs(v) / math.sqrt(2)) for v in z], "odds_ratio": np.exp(beta).tolist(), "pseudo_r2": 1 - ll / null, "n": n}


def wild_cluster_bootstrap(df: DataFrame, y: str, x: str, extra: str, cluster: str = "week", reps: int = 999, seed: int = 20260905) -> dict:
    """Rademacher signs per cluster on restricted residuals; p-value of ``extra``.

    Clusters are summed to one number each, their part in the coefficient; a replicate is the
    sum of these under signs that are hashed from seed, replicate and cluster, so that it can be
    drawn again anywhere.  Clusters and replicates meet in one small aggregate.
    """
    d = df.select(cluster, y, x, extra).dropna().withColumn("__one", F.lit(1.0))
    cols = ["__one", x, extra]
    g, b, _, n = gram(d, cols, y)
    inv = np.linalg.pinv(g)
    beta = inv @ b
    beta0 = np.linalg.lstsq(g[:2, :2], b[:2], rcond=None)[0]
    fitted = float(beta0[0]) + float(beta0[1]) * F.col(x)
    pull = sum((float(v) * F.col(c) for v, c in zip(inv[2], cols)), F.lit(0.0))
    per = d.groupBy(F.col(cluster).cast("string").alias("c")).agg(F.sum(pull * fitted).alias("f"), F.sum(pull * (F.col(y) - fitted)).alias("u"))
    even = F.substring(F.md5(F.concat_ws("|", F.lit(seed), "rep", "c")), 1, 1).isin(*"02468ace")
    drawn = per.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).groupBy("rep").agg(F.sum("f").alias("f"), F.sum(F.when(even, F.col("u")).otherwise(-F.col("u"))).alias("s"), F.count(F.lit(1)).alias("k"))
    r = drawn.agg(F.avg((F.abs(F.col("f") + F.col("s")) >= abs(float(beta[2]))).cast("double")).alias("p"), F.max("k").alias("k")).first()
    return {"beta": float(beta[2]), "p": r["p"], "n_clusters": r["k"] or 0, "n_obs": n, "n_boot": reps}


# ------------------------------------------------------------------ Student t
def t_cdf(t: float, df: float) -> float:
    """Through the incomplete beta function's continued fraction."""
    x = df / (df + t * t)
    tail = 0.5 * _beta_inc(df / 2, 0.5, x)
    return 1 - tail if t >= 0 else tail


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def _beta_inc(a: float, b: float, x: float) -> float:
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def minimal_effect(se: float, clusters: int, power_z: float = 0.84) -> dict:
    crit = t_quantile(0.975, max(1, clusters - 1))
    return {"t_crit": crit, "mde": (crit + power_z) * se}
