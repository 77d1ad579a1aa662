"""Look-back columns that never see the current row or the future.

``T(x, k, m)``: an aggregate over the ``k`` preceding rows of an entity, null unless at
least ``m`` of them are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by(entity, order) -> WindowSpec:
    entity = entity if isinstance(entity, (list, tuple)) else [entity]
    order = order if isinstance(order, (list, tuple)) else [order]
    return Window.partitionBy(*entity).orderBy(*order)


def trailing(x: Column, k: int, least: int, w: WindowSpec, agg=F.avg) -> Column:
    frame = w.rowsBetween(-k, -1)
    return F.when(F.count(x).over(frame) >= least, agg(x).over(frame))


def abnormal(x: Column, w: WindowSpec, k: int = 8, least: int = 8, positive_only: bool = False) -> Column:
    """log level minus its trailing mean; logs of positive values only, if asked for."""
    f = F.when(x > 0, F.ln(x)) if positive_only else F.log1p(x)
    return f - trailing(f, k, least, w)


def nonzero_count(x: Column, w: WindowSpec, k: int = 52) -> Column:
    return trailing((x > 0).cast("int"), k, 1, w, F.sum)


def initiation(x: Column, w: WindowSpec, k: int = 8) -> Column:
    return F.coalesce((x > 0) & zero_base(x, w, k), F.lit(False))


def zero_base(x: Column, w: WindowSpec, k: int = 8) -> Column:
    """A full look-back without a single event."""
    return F.coalesce(trailing(x, k, k, w, F.sum) == 0, F.lit(False))


def sparsity_tier(nonzero: Column, dense: int = 40, silent: int = 3) -> Column:
    return F.when(nonzero >= dense, "dense").when(nonzero <= silent, "silent").when(nonzero.isNotNull(), "sparse")


def lead_contiguous(x: Column, week: Column, h: int, w: WindowSpec) -> Column:
    """The value ``h`` rows on, if that row is exactly ``h`` weeks later."""
    return F.when(F.lead(week, h).over(w) == F.date_add(week, 7 * h), F.lead(x, h).over(w))


def log_momentum(r: Column, k: int, w: WindowSpec) -> Column:
    """Sum of the trailing log returns."""
    return trailing(F.log1p(r), k, max(2, k // 2), w, F.sum)


def momentum(r: Column, k: int, w: WindowSpec) -> Column:
    return F.expm1(log_momentum(r, k, w))


def volatility(r: Column, k: int, least: int, w: WindowSpec) -> Column:
    return trailing(r, k, least, w, F.stddev_samp)


def rolling_volatility_with_current(r: Column, k: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(1 - k, 0)
    return F.when(F.count(r).over(frame) >= max(5, k // 2), F.stddev_samp(r).over(frame))


def pct_change(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


def ffill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def backwards(entity, order) -> WindowSpec:
    """The rows of an entity from the last to the current one.

    A frame that reaches from the current row to the last is recomputed for every row;
    read from the end, the same frame only grows.
    """
    entity = entity if isinstance(entity, (list, tuple)) else [entity]
    order = order if isinstance(order, (list, tuple)) else [order]
    return Window.partitionBy(*entity).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)


def bfill(x: Column, entity, order) -> Column:
    return F.last(x, ignorenulls=True).over(backwards(entity, order))


def suffix_product(x: Column, entity, order) -> Column:
    """Product of this and all later rows."""
    return F.product(x).over(backwards(entity, order))


def running_sum(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def running_max(x: Column, w: WindowSpec) -> Column:
    return F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def zscore(x: Column, group: WindowSpec) -> Column:
    sd = F.stddev_samp(x).over(group)
    return F.try_divide(x - F.avg(x).over(group), F.nullif(sd, F.lit(0.0)))


def average_rank(x: Column, group: list) -> Column:
    """Ranks from 1; ties share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*group).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, x)) - 1) / 2.0


def qcut_first(x: Column, n: int, group: list, tie) -> Column:
    """Quantile bucket 1..n of the rank of first appearance (``tie`` orders equal values)."""
    r = F.row_number().over(Window.partitionBy(*group).orderBy(x, tie)).cast("bigint")
    size = F.count(F.lit(1)).over(Window.partitionBy(*group))
    up = F.when(size > 1, F.ceil((r - 1) * n / F.nullif(size - 1, F.lit(0)))).otherwise(1)
    exact = F.floor(((r - 1) * n + size - 2) / F.nullif(size - 1, F.lit(0)))
    return F.greatest(F.lit(1), F.coalesce(exact, up)).cast("int")


def every_kth(k: int, w: WindowSpec) -> Column:
    return (F.row_number().over(w) - 1) % k == 0


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_corr(x, y) -> Column:
    """Pearson correlation; null without spread (the built-in one raises under ANSI)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
