"""Forecast models on distributed sums: ridge, logistic, boosted trees, walk-forward."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from . import boosting, evaluate, forecast, prefix
from .estimators import gram, logit


@dataclass
class Prepared:
    """In-fold medians, missing indicators and scales; fitted on training rows only."""

    features: list[str]
    medians: dict[str, float]
    indicators: list[str]
    centre: dict[str, float]
    scale: dict[str, float]

    @property
    def columns(self) -> list[str]:
        return [f"z_{c}" for c in [*self.features, *(f"miss_{c}" for c in self.indicators)]]

    def _imputed(self, df: DataFrame) -> DataFrame:
        miss = {f"miss_{c}": F.col(c).isNull().cast("double") for c in self.indicators}
        return df.withColumns(miss).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.features})

    def apply(self, df: DataFrame) -> DataFrame:
        raw = self._imputed(df)
        names = [*self.features, *(f"miss_{c}" for c in self.indicators)]
        return raw.withColumns({f"z_{c}": (F.col(c) - self.centre[c]) / self.scale[c] for c in names})


def prepare(train: DataFrame, features: list[str]) -> Prepared:
    """Medians by percentile; all-missing features are dropped; scales use ddof 0."""
    middle = {r["variable"]: r["q"][0] for r in exact_percentiles(train, features, [0.5]).collect()}  # a row a feature
    row = train.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in features]).first()
    kept = [c for c in features if middle[c] is not None]
    p = Prepared(kept, {c: float(middle[c]) for c in kept}, [c for c in kept if row[f"n_{c}"]], {}, {})
    names = [*kept, *(f"miss_{c}" for c in p.indicators)]
    if names:
        s = p._imputed(train).agg(*[F.avg(c).alias(f"a_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
        p.centre = {c: float(s[f"a_{c}"]) for c in names}
        p.scale = {c: float(s[f"s_{c}"] or 1.0) for c in names}
    return p


@dataclass
class Ridge:
    prepared: Prepared
    intercept: float
    weights: dict[str, float]
    alpha: float

    def value(self) -> Column:
        """The prediction, over the columns that ``prepared.apply`` makes."""
        return sum((F.lit(w) * F.col(c) for c, w in self.weights.items()), F.lit(self.intercept))

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        z = self.prepared.apply(df)
        made = [*(f"miss_{c}" for c in self.prepared.indicators), *self.prepared.columns]
        originals = [F.col(c) for c in df.columns if c not in self.prepared.features]
        return z.withColumn(out, self.value()).select(*originals, out).drop(*made)


def ridges(train: DataFrame, features: list[str], y: str, alphas) -> list[Ridge]:
    """Closed forms for several penalties from one Gram aggregate; the intercept is not penalised."""
    d = train.where(F.col(y).isNotNull())
    p = prepare(d, features)
    mean = float(d.agg(F.avg(y)).first()[0] or 0.0)
    if not p.columns:
        return [Ridge(p, mean, {}, a) for a in alphas]
    g, b, *_ = gram(p.apply(d).withColumn("__y", F.col(y) - mean), p.columns, "__y")
    return [Ridge(p, mean, dict(zip(p.columns, map(float, np.linalg.solve(g + a * np.eye(len(b)), b)))), a) for a in alphas]


def ridge(train: DataFrame, features: list[str], y: str, alpha: float) -> Ridge:
    return ridges(train, features, y, [alpha])[0]


def constant(train: DataFrame, y: str) -> float:
    return train.agg(F.avg(y)).first()[0]


def logistic(train: DataFrame, features: list[str], y: str, c: float = 1.0):
    """Regularised logistic regression (penalty 1 / (C n), standardised inputs)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    d = train.where(F.col(y).isNotNull())
    p = prepare(d, features)
    n = d.count()
    vec = VectorAssembler(inputCols=p.columns, outputCol="__x")
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1.0 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=200).fit(vec.transform(p.apply(d).withColumn("__y", F.col(y).cast("double"))))
    return p, vec, model


def boosted_trees(train: DataFrame, features: list[str], y: str, iterations: int = 200, rate: float = 0.05, max_leaves: int = 15, least_leaf: int = 100, l2: float = 10.0) -> tuple[Prepared, boosting.Boosted]:
    """Histogram boosting behind in-fold medians and missing indicators."""
    d = train.where(F.col(y).isNotNull())
    p = prepare(d, features)
    return p, boosting.fit(p.apply(d), p.columns, y, iterations, rate, max_leaves, least_leaf, l2)


def predict_boosted(fitted: tuple[Prepared, boosting.Boosted], rows: DataFrame, keep: list[str], out: str = "pred") -> DataFrame:
    p, model = fitted
    return model.predict(p.apply(rows), keep, out)


def platt(df: DataFrame, score: str, y: str, least: int = 100) -> tuple[float, float] | None:
    """Slope and intercept of a one-dimensional logistic calibration; None without support."""
    row = df.dropna(subset=[score, y]).agg(F.count(F.lit(1)), F.countDistinct(y)).first()
    if row[0] < least or row[1] < 2:
        return None
    fit = logit(df, y, [score])
    return fit["beta"][1], fit["beta"][0]


def select_alpha(xy: DataFrame, features: list[str], y: str, alphas=(0.1, 1.0, 10.0, 100.0), n_blocks: int = 3, size: int = 26, least_weeks: int = 104, least: int = 30) -> float:
    """Alpha of the best mean rank IC over inner forward blocks; ties take the larger."""
    blocks = prefix.blocks_before(prefix.training_weeks(xy, y), prefix.NEVER, n_blocks, size, least_weeks)
    if not blocks:
        return max(alphas)
    sums = prefix.Prefix(xy, features, y, [b[0] for b in blocks])
    return prefix.select_alphas(xy, sums, {prefix.NEVER: blocks}, {"": list(features)}, alphas, least)[prefix.NEVER, ""]


def select_c(xy: DataFrame, features: list[str], y: str, values=(0.01, 0.1, 1.0, 10.0), n_blocks: int = 3, size: int = 26, least_weeks: int = 104) -> tuple[float, DataFrame]:
    """C of the smallest mean Brier score over inner forward blocks (ties: the smaller), and the record of all.

    Blocks with fewer than 100 training or 50 validation rows are passed over; without any
    inner block the last quarter of the weeks (``size`` at most) is the one block.
    """
    spark = xy.sparkSession
    blocks = validation_blocks(xy, n_blocks, size, least_weeks)
    if not blocks:
        return values[len(values) // 2], spark.createDataFrame([], "c double, mean_brier double, n_blocks int")
    scores: dict[float, list[float]] = {c: [] for c in values}
    for before, first, stop in blocks:
        train, valid = forecast.mature(xy, before, y), _valid(xy, first, stop, y)
        if train.count() < 100 or valid.count() < 50:
            continue
        for c in values:
            scores[c].append(evaluate.brier(predict_probability(logistic(train, features, y, c), valid), "prob", y).first()["brier"])
    record = [(float(c), sum(s) / len(s) if s else float("inf"), len(s)) for c, s in scores.items()]
    best = min(record, key=lambda r: (r[1], r[0]))[0]
    return best, spark.createDataFrame(record, "c double, mean_brier double, n_blocks int")


def validation_blocks(xy: DataFrame, n_blocks: int = 3, size: int = 26, least_weeks: int = 104) -> list[tuple]:
    """(train before, first, stop) of each inner block, the stop excluded; one block of the last weeks if there is none."""
    weeks = sorted(r[0] for r in xy.select("as_of").where("as_of IS NOT NULL").distinct().collect())  # dates of a weekly panel
    one = dt.timedelta(days=1)
    blocks = [(b, first, last + one) for b, first, last in forecast.inner_blocks(weeks, n_blocks, size, least_weeks)]
    if blocks or len(weeks) < 4:
        return blocks
    start = weeks[-min(size, len(weeks) // 4)]
    return [(start, start, weeks[-1] + one)]


def _valid(xy: DataFrame, first, stop, y: str) -> DataFrame:
    return xy.where((F.col("as_of") >= F.lit(first)) & (F.col("as_of") < F.lit(stop)) & F.col(y).isNotNull() & (F.col("label_status") == "ok"))


def predict_probability(fitted, rows: DataFrame, out: str = "prob") -> DataFrame:
    """``rows`` with the probability of a fitted logistic regression."""
    from pyspark.ml.functions import vector_to_array

    p, vec, model = fitted
    made = model.transform(vec.transform(p.apply(rows)))
    return made.withColumn(out, vector_to_array("probability")[1]).select(*rows.columns, out)


def out_of_fold(xy: DataFrame, features: list[str], y: str, c: float, **blocks) -> DataFrame | None:
    """Rows of the inner blocks with the probability of the model that had not seen them; None without a usable block."""
    out = None
    for before, first, stop in validation_blocks(xy, **blocks):
        train, valid = forecast.mature(xy, before, y), _valid(xy, first, stop, y)
        if train.count() < 100 or valid.count() < 50:
            continue
        rows = predict_probability(logistic(train, features, y, c), valid).select("as_of", y, "prob")
        out = rows if out is None else out.unionByName(rows)
    return out


def calibrated(xy: DataFrame, features: list[str], y: str, c: float, **blocks) -> tuple[float, float] | None:
    """Platt slope and intercept on out-of-fold probabilities; None without support."""
    rows = out_of_fold(xy, features, y, c, **blocks)
    return None if rows is None else platt(rows, "prob", y)


def walk_forward(xy: DataFrame, features: list[str], y: str, refits: list, alpha: float | None = 10.0, horizon_end=None, sets: dict[str, list[str]] | None = None, n_blocks: int = 3, size: int = 26, least_weeks: int = 104) -> DataFrame:
    """Predictions between consecutive refit dates from models trained on mature rows only.

    ``alpha`` None: chosen at each refit by inner forward blocks of the mature rows.  The number
    of jobs does not depend on the number of refits (see ``prefix``).
    """
    return prefix.walk_forward(xy, y, list(refits), sets or {"A": list(features)}, alpha, horizon_end=horizon_end, n_blocks=n_blocks, size=size, least_weeks=least_weeks)


def compare_sets(pred: DataFrame, y: str, base: str, candidate: str, least: int = 30, reps: int = 2000) -> dict:
    """Paired IC difference of two feature sets with its bootstrap interval and gate."""
    ic = {s: evaluate.weekly_rank_ic(pred.where(F.col("feature_set") == s), "pred", y, least) for s in (base, candidate)}
    delta = evaluate.paired_delta(ic[candidate], ic[base]).cache()
    boot = evaluate.block_bootstrap(delta, "delta_ic", reps=reps).first()
    years = delta.groupBy(F.year("as_of").alias("y")).agg(F.avg("delta_ic").alias("m")).agg(F.count_if(F.col("m") > 0), F.count(F.lit(1))).first()
    mean_ic = ic[candidate].agg(F.avg("ic")).first()[0]
    delta.unpersist()
    ok = {"gate_candidate_ic": (mean_ic or 0) > 0, "gate_mean_delta": (boot["mean"] or 0) > 0, "gate_boot_low": (boot["ci_low"] or 0) > 0, "gate_years": years[0] >= 3}
    return {"candidate_ic": mean_ic, "delta": boot["mean"], "ci_low": boot["ci_low"], "ci_high": boot["ci_high"], "years_positive": years[0], "n_years": years[1], **ok, "gain": all(ok.values())}
