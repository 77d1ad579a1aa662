"""Append-only prediction ledger, skip log, scores and model store as Parquet tables.

A ledger table is a folder of batches and of numbered manifests.  A writer stages its batch
under a name of its own, checks its keys against the batches committed so far, and commits by
creating the next manifest, which succeeds for one writer only; who comes second checks against
what was committed meanwhile and tries the next number.  Readers follow the manifests, so a
batch is there whole or not at all, and a batch whose writer died is never seen.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["run_id", "as_of", "ticker", "horizon", "model_version"]
_MANIFESTS, _BATCHES = "_manifests", "batches"


# ------------------------------------------------------------------ files of a table
def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, batch) in the order of the commits; a manifest a batch."""
    fs, at = _fs(spark, f"{path}/{_MANIFESTS}")
    if not fs.exists(at) or not any(s.getPath().getName().endswith(".json") for s in fs.listStatus(at)):
        return []
    lines = spark.read.text(f"{path}/{_MANIFESTS}/*.json").collect()  # one line a batch
    return sorted((m["version"], m["batch"]) for m in (json.loads(r["value"]) for r in lines))


def _create(spark: SparkSession, path: str, version: int, batch: str) -> bool:
    """Manifest ``version`` with its content, unless it exists; whole from the moment it is visible.

    A local file becomes visible by a hard link, one elsewhere by a rename that does not
    overwrite: both fail for the second writer.
    """
    jvm, body = spark.sparkContext._jvm, json.dumps({"version": version, "batch": batch})
    folder = f"{path}/{_MANIFESTS}"
    fs, at = _fs(spark, folder)
    fs.mkdirs(at)
    staged, final = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{version:012d}.json"
    sp, fp = (jvm.org.apache.hadoop.fs.Path(x) for x in (staged, final))
    out = fs.create(sp, False)
    out.write(bytearray(body.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            try:
                os.link(sp.toUri().getPath(), fp.toUri().getPath())
            except FileExistsError:
                return False
            return True
        if fs.exists(fp):
            return False
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(sp, fp, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
    finally:
        if fs.exists(sp):
            fs.delete(sp, False)


def _read(spark: SparkSession, path: str, batches: list[str]) -> DataFrame | None:
    if not batches:
        return None
    return spark.read.option("mergeSchema", "true").parquet(*[f"{path}/{_BATCHES}/{b}" for b in batches])


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed rows; None before the first commit."""
    return _read(spark, path, [b for _, b in committed(spark, path)])


def conflicts(new: DataFrame, old: DataFrame | None, keys: list[str] = KEYS) -> DataFrame:
    """Keys of ``new`` that repeat in it or are in ``old`` already."""
    twice = new.groupBy(*keys).count().where("count > 1").select(*keys)
    return twice if old is None else twice.unionByName(new.select(*keys).join(old, keys, "left_semi")).distinct()


def _commit(spark: SparkSession, path: str, stage, attempts: int = 100) -> bool:
    """Commit what ``stage(old)`` returns for the rows committed so far: a frame, or None for nothing to add.

    ``stage`` is called again with what others committed since, when they were first.
    """
    seen: list[tuple[int, str]] = []
    frame, name = None, ""
    for _ in range(attempts):
        now = committed(spark, path)
        fresh = [b for v in now if v not in seen for b in [v[1]]]
        if frame is None or fresh:
            source = spark.read.parquet(f"{path}/{_BATCHES}/{name}") if frame is not None else None
            frame = stage(_read(spark, path, fresh), source)
            if frame is None:
                return False
            staged = uuid.uuid4().hex
            frame.write.parquet(f"{path}/{_BATCHES}/{staged}")
            if name:
                _drop(spark, path, name)
            name = staged
        seen = now
        if _create(spark, path, (now[-1][0] if now else 0) + 1, name):
            return True
    raise RuntimeError("the ledger was busy")


def _drop(spark: SparkSession, path: str, batch: str) -> None:
    fs, at = _fs(spark, f"{path}/{_BATCHES}/{batch}")
    fs.delete(at, True)


def append_immutable(spark: SparkSession, new: DataFrame, path: str, keys: list[str] = KEYS) -> None:
    """Append, or fail and add nothing when a key is there already; of two writers of a key one fails."""

    def stage(old: DataFrame | None, own: DataFrame | None) -> DataFrame:
        rows = new if own is None else own
        if not conflicts(rows, old, keys).isEmpty():
            raise ValueError("the ledger holds some of these keys already")
        return rows

    _commit(spark, path, stage)


def append_missing(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key is not there; nothing happens the second time.

    Of new rows that share a key the smallest (by their other columns as text) is written.
    """
    rest = [c for c in new.columns if c not in keys]
    if rest:
        one = F.min_by(F.struct(*rest), F.to_json(F.struct(*rest)))
        new = new.groupBy(*keys).agg(one.alias("__r")).select(*keys, "__r.*").select(*new.columns)
    else:
        new = new.distinct()

    def stage(old: DataFrame | None, own: DataFrame | None) -> DataFrame | None:
        rows = new if own is None else own
        left = rows if old is None else rows.join(old, keys, "left_anti")
        return None if left.isEmpty() else left

    _commit(spark, path, stage)


def keep_last(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: of the rows of a key the one with the largest ``order`` stays; new rows win ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def unscored(predictions: DataFrame, scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return predictions.join(scores, keys, "left_anti")


def score_mature(predictions: DataFrame, labels: DataFrame, cutoff, keys: list[str] = ("as_of", "ticker", "horizon")) -> DataFrame:
    """Predictions joined to labels known before ``cutoff``."""
    c = F.lit(cutoff).cast("date")
    ripe = labels.where((F.col("label_status") == "ok") & (F.col("label_available_at") < c))
    return predictions.join(ripe, list(keys))


def watchlist(predictions: DataFrame, pred: str, n: int = 20, tie: str = "ticker") -> DataFrame:
    w = Window.partitionBy("as_of").orderBy(F.desc(pred), tie)
    return predictions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def operational_status(expected: DataFrame, predictions: DataFrame, skips: DataFrame) -> DataFrame:
    """predicted / skipped / missing for every expected as_of."""
    p = predictions.groupBy("as_of").agg(F.count(F.lit(1)).alias("n_predictions"))
    s = skips.select("as_of").distinct().withColumn("__skipped", F.lit(True))
    out = expected.join(p, "as_of", "left").join(s, "as_of", "left")
    status = F.when(F.col("n_predictions") > 0, "predicted").when(F.col("__skipped"), "skipped").otherwise("missing")
    return out.select("as_of", F.coalesce("n_predictions", F.lit(0)).alias("n_predictions"), status.alias("status"))


def save_model(spark: SparkSession, model, as_of: str, path: str) -> None:
    """A ridge model as one row of maps; a later model of the same date takes its place."""
    p = model.prepared
    spark.createDataFrame(
        [(as_of, model.alpha, model.intercept, model.weights, p.features, p.medians, p.indicators, p.centre, p.scale)],
        "as_of string, alpha double, intercept double, weights map<string,double>, features array<string>, medians map<string,double>, indicators array<string>, centre map<string,double>, scale map<string,double>",
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)


def load_model(spark: SparkSession, as_of: str, path: str):
    from .models import Prepared, Ridge

    r = spark.read.parquet(path).where(F.col("as_of").cast("string") == as_of).first()
    if r is None:
        return None
    return Ridge(Prepared(r["features"], r["medians"], r["indicators"], r["centre"], r["scale"]), r["intercept"], r["weights"], r["alpha"])


def coverage_metrics(predictions: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: counts of predictions, scored ones and those without a usable label, and their rates."""
    a = predictions.agg(F.count(F.lit(1)).alias("n_predictions"), F.count_if(F.coalesce(F.col("label_status"), F.lit("")) != "ok").alias("n_missing_label"))
    b = scored.agg(F.count(F.lit(1)).alias("n_scored"))
    return a.join(F.broadcast(b)).select("n_predictions", "n_scored", "n_missing_label", (F.col("n_predictions") > 0).cast("double").alias("prediction_rate"), F.try_divide("n_scored", "n_predictions").alias("scorable_rate"))


def news_coverage(rows: DataFrame, matched: DataFrame, entity: str, count: str = "news_count_1w") -> DataFrame:
    """One row: panel rows with news, their share, and the share of the matched items that one entity has."""
    a = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(count) > 0).alias("n_with_news"))
    b = matched.agg(F.avg((F.col("ticker") == entity).cast("double")).alias("entity_share"))
    return a.join(F.broadcast(b)).select("n_rows", "n_with_news", F.try_divide("n_with_news", "n_rows").alias("news_share"), "entity_share")
