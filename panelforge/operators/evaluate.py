"""Forecast evaluation: rank correlations, errors, calibration, gates, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W


def weekly_rank_ic(df: DataFrame, pred: str, y: str, least: int = 30, group=("as_of",)) -> DataFrame:
    """Spearman correlation per week; null with fewer names or a constant prediction."""
    g = list(group)
    rows = df.dropna(subset=[pred, y])
    ranked = rows.withColumns({"__rp": W.average_rank(F.col(pred), g), "__ry": W.average_rank(F.col(y), g)})
    out = ranked.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), W.safe_corr("__rp", "__ry").alias("__ic"), F.min(pred).alias("__lo"), F.max(pred).alias("__hi"), F.min(y).alias("__ly"), F.max(y).alias("__hy"))
    fine = (F.col("n") >= least) & (F.col("__lo") < F.col("__hi")) & (F.col("__ly") < F.col("__hy"))
    return out.select(*g, "n", F.when(fine, F.col("__ic")).alias("ic"), (F.col("n") >= least).alias("sufficient"))


def summarise(ics: DataFrame, x: str = "ic", group: list | None = None) -> DataFrame:
    return ics.groupBy(*(group or [])).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n_weeks"), F.avg(F.when(F.col(x).isNotNull(), (F.col(x) > 0).cast("double"))).alias("pos_share"))


def paired_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """ic_a - ic_b on weeks that are sufficient in both."""
    left = a.where("sufficient").select("as_of", F.col("ic").alias("ic_a"))
    return left.join(b.where("sufficient").select("as_of", F.col("ic").alias("ic_b")), "as_of").withColumn("delta_ic", F.col("ic_a") - F.col("ic_b"))


def non_overlapping(weekly: DataFrame, k: int = 4, order: str = "as_of") -> DataFrame:
    """Every k-th week of a weekly series."""
    return weekly.withColumn("__k", W.every_kth(k, Window.orderBy(order))).where("__k").drop("__k")


def top_fraction(df: DataFrame, pred: str, y: str, frac: float = 0.2, least: int = 5, tie: str = "ticker") -> DataFrame:
    """Weekly mean and hit rate of the best max(1, floor(n * frac)) names."""
    rows = df.dropna(subset=[pred, y])
    n = F.count(F.lit(1)).over(Window.partitionBy("as_of"))
    r = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc(pred), tie))
    top = rows.withColumns({"__n": n, "__r": r}).where((F.col("__n") >= least) & (F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") * frac))))
    return top.groupBy("as_of").agg(F.avg(y).alias("mean_excess"), F.avg((F.col(y) > 0).cast("double")).alias("outperform_rate"), F.count(F.lit(1)).alias("k"))


def regression_errors(df: DataFrame, pred: str, y: str) -> DataFrame:
    e = F.col(y) - F.col(pred)
    return df.dropna(subset=[pred, y]).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def brier(df: DataFrame, p: str, y: str) -> DataFrame:
    return df.dropna(subset=[p, y]).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.count(F.lit(1)).alias("n"))


def paired_brier(df: DataFrame, a: str, b: str, y: str, group: list[str] | None = None) -> DataFrame:
    """Brier scores of two forecasts on the rows that have both, and how much better the second is."""
    square = lambda p: F.avg((F.col(p) - F.col(y)) ** 2)
    out = df.dropna(subset=[a, b, y]).groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("n"), square(a).alias("brier_a"), square(b).alias("brier_b"))
    return out.withColumn("delta_b_minus_a", F.col("brier_a") - F.col("brier_b"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Uniform bins, a probability on an edge in the lower one; empty bins are absent."""
    b = F.greatest(F.ceil(F.col(p) * bins) - 1, F.lit(0)).cast("int")
    return df.dropna(subset=[p, y]).groupBy(b.alias("bin")).agg(F.avg(p).alias("mean_pred"), F.avg(y).alias("frac_pos"), F.count(F.lit(1)).alias("n"))


def classification(df: DataFrame, p: str, y: str) -> DataFrame:
    """AUC from rank sums of a value histogram, balanced accuracy at 0.5, base rate, Brier.

    The running count over distinct scores stands in for ranking all rows in one task:
    scores are aggregated first, so equal scores meet once.
    """
    rows = df.dropna(subset=[p, y])
    hist = rows.groupBy(F.col(p).alias("p")).agg(F.sum(y).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    cell = F.floor(F.col("p") * 1024)
    w = Window.partitionBy("cell").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    cells = hist.withColumn("cell", cell)
    sums = cells.groupBy("cell").agg(F.sum(F.col("n") - F.col("pos")).alias("neg"))
    before = sums.select("cell", F.coalesce(F.sum("neg").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("below"))  # 1025 rows at most
    inner = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(w), F.lit(0.0))
    u = cells.withColumn("inner", inner).join(F.broadcast(before), "cell").agg(F.sum(F.col("pos") * (F.col("below") + F.col("inner") + (F.col("n") - F.col("pos")) / 2)).alias("u"))
    hit = (F.col(p) >= 0.5).cast("int")
    base = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).cast("double").alias("n_pos"), F.avg(y).alias("positive_rate"),
        F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"),
        ((F.avg(F.when(F.col(y) == 1, hit)) + F.avg(F.when(F.col(y) == 0, 1 - hit))) / 2).alias("balanced_accuracy"),
    )
    return base.join(F.broadcast(u)).select("n", "positive_rate", "brier", "balanced_accuracy", F.try_divide("u", F.nullif(F.col("n_pos") * (F.col("n") - F.col("n_pos")), F.lit(0.0))).alias("roc_auc"))


def nav_metrics(nav: DataFrame, order: str = "as_of", group: str = "strategy", initial: float | None = None) -> DataFrame:
    """Total return, maximal drawdown and annualised weekly volatility per strategy."""
    w = W.by(group, order)
    rows = nav.withColumns({"__peak": W.running_max(F.col("nav"), w), "__ret": W.pct_change(F.col("nav"), w)})
    dd = F.try_divide(F.col("nav") - F.col("__peak"), F.nullif(F.col("__peak"), F.lit(0.0)))
    base = F.lit(initial) if initial is not None else F.min_by("nav", order)
    final = F.max_by("nav", order)
    return rows.groupBy(group).agg((F.try_divide(final, F.nullif(base, F.lit(0.0))) - 1).alias("total_return"), F.min(dd).alias("max_drawdown"), (F.stddev_samp("__ret") * float(52**0.5)).alias("ann_vol_weekly"), F.count(F.lit(1)).alias("n_periods"), final.alias("final_nav"))


def gain_gate(ic: Column, delta: Column, ci_low: Column, years: Column, least_years: int = 3) -> dict[str, Column]:
    yes = lambda c: F.coalesce(c > 0, F.lit(False))
    gates = {"gate_candidate_ic": yes(ic), "gate_mean_delta": yes(delta), "gate_boot_low": yes(ci_low), "gate_years": years >= least_years}
    return gates | {"gain": gates["gate_candidate_ic"] & gates["gate_mean_delta"] & gates["gate_boot_low"] & gates["gate_years"]}


def trading_gate(drawdown: Column, total_return: Column | None = None, limit: float = 0.35) -> Column:
    blocked = F.coalesce(F.abs(drawdown) > limit, F.lit(False))
    return ~(blocked | F.coalesce(total_return <= 0, F.lit(False))) if total_return is not None else ~blocked


def block_bootstrap(weekly: DataFrame, x: str, order: str = "as_of", block: int = 8, reps: int = 2000, seed: int = 42) -> DataFrame:
    """Mean of a weekly series with a 95 % block-bootstrap interval.

    Replicates are rows: hashed block starts, exploded to positions and joined to the
    series (one row a week, hence broadcast), truncated to the series' length.
    """
    s = weekly.where(F.col(x).isNotNull()).select((F.row_number().over(Window.orderBy(order)) - 1).alias("pos"), F.col(x).alias("x"))
    size = s.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))
    spark = weekly.sparkSession
    plan = spark.range(reps).crossJoin(F.broadcast(size)).withColumn("b", F.greatest(F.lit(1), F.least(F.lit(block), F.col("n"))))
    plan = plan.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("b")) - 1)))
    plan = plan.withColumn("start", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "id", "k")), 1, 15), 16, 10).cast("bigint"), F.greatest(F.lit(1), F.col("n") - F.col("b") + 1)))
    draws = plan.select("id", "n", "mean", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("i"), "k", "b", "start").where(F.col("k") * F.col("b") + F.col("i") < F.col("n"))
    means = draws.select("id", "n", "mean", (F.col("start") + F.col("i")).alias("pos")).join(F.broadcast(s), "pos").groupBy("id").agg(F.avg("x").alias("m"), F.first("n").alias("n"), F.first("mean").alias("mean"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(F.first("mean").alias("mean"), q[0].alias("ci_low"), q[1].alias("ci_high"), F.first("n").alias("n"))
