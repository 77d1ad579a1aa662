"""The prospective loop: predict for a date once, keep it, score it when its label is known.

State is four tables under one folder: ``predictions`` and ``scores`` (append-only), ``skips``
(one row a date) and ``models`` (one ridge a date and feature set).  A date is predicted at most once;
every reason not to is written down.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import forecast, ledger, models


@dataclass(frozen=True)
class Loop:
    """Where the state is, and what is predicted from what."""

    path: str
    sets: dict[str, list[str]]
    y: str = "y_excess"
    tiers: tuple[str, ...] = ("dense", "sparse")
    least_names: int = 30
    alpha: float | None = None  # None: chosen by inner blocks
    horizon: str = "1w"
    run_id: str = "prospective"
    version: str = "v1"
    entity: str = "ticker"
    keys: tuple[str, ...] = field(default=("run_id", "as_of", "ticker", "horizon", "model_version"))

    def table(self, name: str) -> str:
        return f"{self.path}/{name}"


def quality(rows: DataFrame, loop: Loop) -> dict:
    """Names of a date, those of a tier that is predicted, and whether they are enough."""
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sparsity_tier").isin(*loop.tiers)).alias("ok")).first()
    return {"n_names": row["n"], "n_scorable": row["ok"], "sufficient": row["ok"] >= loop.least_names}


def skip_reason(spark: SparkSession, features: DataFrame, as_of: dt.date, loop: Loop) -> str | None:
    """Why a date is not predicted: it was already, it has no features, or too few names."""
    done = ledger.read_or_none(spark, loop.table("predictions"))
    if done is not None and not done.where(F.col("as_of") == F.lit(as_of)).isEmpty():
        return "duplicate_as_of"
    rows = features.where(F.col("as_of") == F.lit(as_of))
    if rows.isEmpty():
        return "as_of_not_in_features"
    return None if quality(rows, loop)["sufficient"] else "insufficient_universe"


def _skipped(spark: SparkSession, features: DataFrame, as_of: dt.date, loop: Loop) -> dict | None:
    """The note of a date that is not predicted."""
    reason = skip_reason(spark, features, as_of, loop)
    if reason and reason != "duplicate_as_of":
        note = spark.createDataFrame([(as_of, reason)], "as_of date, reason string")
        ledger.append_missing(spark, note, loop.table("skips"), ["as_of"])
    return {"as_of": as_of, "status": "skipped", "reason": reason} if reason else None


def predict(spark: SparkSession, features: DataFrame, labels: DataFrame, as_of: dt.date, loop: Loop, refit: bool = False) -> dict:
    """Predictions of every feature set for one date, appended; or the reason why not."""
    skipped = _skipped(spark, features, as_of, loop)
    if skipped:
        return skipped
    return _predicted(spark, features, features.join(labels, ["as_of", loop.entity], "left"), as_of, loop, refit)


def _predicted(spark: SparkSession, features: DataFrame, xy: DataFrame, as_of: dt.date, loop: Loop, refit: bool) -> dict:
    train = forecast.mature(xy.where(F.col("sparsity_tier").isin(*loop.tiers)), as_of, loop.y)
    rows = features.where(F.col("as_of") == F.lit(as_of))
    out = None
    for name, cols in loop.sets.items():
        store = loop.table(f"models/{name}")
        known = None if refit or ledger.read_or_none(spark, store) is None else ledger.load_model(spark, str(as_of), store)
        if known is None:
            known = models.ridge(train, cols, loop.y, models.select_alpha(train, cols, loop.y) if loop.alpha is None else loop.alpha)
            ledger.save_model(spark, known, str(as_of), store)
        one = known.predict(rows).select(F.col(loop.entity).alias("ticker"), "as_of", "sparsity_tier", F.col("pred").alias(f"pred_{name}"))
        out = one if out is None else out.join(one.drop("sparsity_tier"), ["ticker", "as_of"])
    base = models.constant(train, loop.y)
    out = out.withColumns({"pred_baseline": F.lit(base).cast("double"), "run_id": F.lit(loop.run_id), "horizon": F.lit(loop.horizon), "model_version": F.lit(loop.version)})
    ledger.append_immutable(spark, out, loop.table("predictions"), list(loop.keys))
    return {"as_of": as_of, "status": "predicted", "n_predictions": out.count()}


def backfill(spark: SparkSession, features: DataFrame, labels: DataFrame, weeks: int, loop: Loop) -> list[dict]:
    """The last ``weeks`` dates one after another, as they would have been met.

    Features and labels are joined once for all dates and models, which then only scan.
    """
    dates = sorted(r[0] for r in features.select("as_of").where("as_of IS NOT NULL").distinct().collect())  # dates of a weekly panel
    used = list(dict.fromkeys(c for cols in loop.sets.values() for c in cols))
    known = list(dict.fromkeys(["label_end_at", "label_available_at", "label_status", loop.y]))
    keys = ["as_of", loop.entity]
    xy, out = None, []
    for d in dates[-weeks:]:
        skipped = _skipped(spark, features, d, loop)
        if skipped is None and xy is None:
            xy = cut_lineage(features.select(*keys, "sparsity_tier", *used).join(labels.select(*keys, *known), keys, "left"))
        out.append(skipped or _predicted(spark, features, xy, d, loop, False))
    return out


def score(spark: SparkSession, labels: DataFrame, cutoff: dt.date, loop: Loop) -> DataFrame | None:
    """Kept predictions with the labels known before ``cutoff``, appended to ``scores`` once each; all scores so far.

    Nothing is rewritten: a prediction that has its score keeps it.  None before the first.
    """
    kept = ledger.read_or_none(spark, loop.table("predictions"))
    if kept is not None:
        ripe = labels.withColumn("horizon", F.lit(loop.horizon)).withColumnRenamed(loop.entity, "ticker")
        ledger.append_missing(spark, ledger.score_mature(kept, ripe, cutoff), loop.table("scores"), list(loop.keys))
    return ledger.read_or_none(spark, loop.table("scores"))


def report(spark: SparkSession, expected: DataFrame, loop: Loop) -> DataFrame:
    """predicted / skipped / missing for every expected date."""
    empty = lambda s: spark.createDataFrame([], s)
    kept, skips = (ledger.read_or_none(spark, loop.table(t)) for t in ("predictions", "skips"))
    return ledger.operational_status(expected, empty("as_of date") if kept is None else kept, empty("as_of date") if skips is None else skips)
