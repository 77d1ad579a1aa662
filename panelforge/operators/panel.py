"""Entity-by-week panels: counts on grids, weekly bars, research and point-in-time panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeops as T
from ..functions import windows as W


def counts(events: DataFrame, keys: list[str], variants: dict[str, Column | None]) -> DataFrame:
    """All count variants in one aggregate: name -> condition (None: every row)."""
    return events.groupBy(*keys).agg(*[(F.count(F.lit(1)) if c is None else F.count_if(c)).alias(n) for n, c in variants.items()])


def grid(entities: DataFrame, entity: str, first: Column | str, last: Column | str) -> DataFrame:
    """Entity x week rows; the bounds may be columns of ``entities`` (start-bounded grids).

    ``explode`` of a week sequence in each entity's row: no join, no shuffle.
    """
    first, last = (F.col(c) if isinstance(c, str) else c for c in (first, last))
    rows = entities.select(entity, first.alias("__a"), last.alias("__b")).where("__a <= __b")
    return rows.select(entity, F.explode(T.weeks_between(F.col("__a"), F.col("__b"))).alias("week"))


def fill_counts(cells: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of counts on a grid; missing counts are true zeros."""
    names = [c for c in counted.columns if c not in keys]
    return cells.join(counted, keys, "left").fillna(0, names)


def fill_weeks(rows: DataFrame, entity: str, first: Column, last: Column, zeros: list[str]) -> DataFrame:
    """``rows`` (one an entity and week) on the entity's whole grid from ``first`` to ``last``.

    Each row also stands for the weeks up to the entity's next row, the first one for those
    before it, so the grid takes neither a list of entities nor a join.  Columns of ``zeros``
    are true zeros in weeks without a row, the others have no value there.
    """
    w = W.by(entity, "week")
    start = F.when(F.lag("week").over(w).isNull(), first).otherwise(F.col("week"))
    stop = F.coalesce(F.date_sub(F.lead("week").over(w), 7), last)
    # An entity without any week still has its grid; beside others a row without a week has none.
    spans = rows.withColumns({"__a": start, "__b": stop, "__none": F.col("week").isNull() & F.lead("week").over(w).isNotNull()}).where("NOT __none AND __a <= __b")
    cells = spans.withColumn("__w", F.explode(T.weeks_between(F.col("__a"), F.col("__b"))))
    own = F.coalesce((F.col("__w") == F.col("week")) & F.col(entity).isNotNull(), F.lit(False))
    value = lambda c: F.when(own, F.coalesce(F.col(c), F.lit(0)) if c in zeros else F.col(c)).otherwise(F.lit(0) if c in zeros else F.lit(None))
    return cells.select(entity, F.col("__w").alias("week"), *[value(c).alias(c) for c in rows.columns if c not in (entity, "week")])


def attention_fields(panel: DataFrame, entity: str = "ticker", level: str = "att_all", lookback: int = 8, long: int = 52) -> DataFrame:
    """Abnormal level, look-back counts, initiation flags and the sparsity tier."""
    w, x = W.by(entity, "week"), F.col(level)
    out = panel.withColumns(
        {
            f"abn_{level}": W.abnormal(x, w, lookback, lookback),
            "att_nonzero_weeks_52": W.nonzero_count(x, w, long),
            "att_mean_level_52": W.trailing(x, long, 1, w),
            "is_initiation": W.initiation(x, w, lookback),
            "att_zero_base": W.zero_base(x, w, lookback).cast("int"),
        }
    )
    return out.withColumn("sparsity_tier", W.sparsity_tier(F.col("att_nonzero_weeks_52")))


#: Labels whose abnormal level is also taken from logs of positive counts only.
POSITIVE_ONLY = ("all", "weekend", "weekday")


def attention_block(panel: DataFrame, entity: str = "ticker", lookback: int = 8, long: int = 52) -> DataFrame:
    """``attention_fields`` and, for every count ``att_<label>``, its abnormal level ``abn_attention_<label>``;
    initiations by part of the week.  All look-backs share one window."""
    labels = [c.removeprefix("att_") for c in panel.columns if c.startswith("att_")]
    w = W.by(entity, "week")
    level = {f"abn_attention_{x}": W.abnormal(F.col(f"att_{x}"), w, lookback, lookback) for x in labels}
    level |= {f"abn_attention_{x}_posonly": W.abnormal(F.col(f"att_{x}"), w, lookback, lookback, True) for x in POSITIVE_ONLY if x in labels}
    out = attention_fields(panel.withColumns(level), entity, "att_all", lookback, long)
    return out.withColumns({f"is_initiation_{x}": F.col("is_initiation") & (F.col(f"att_{x}") > 0) for x in ("weekend", "weekday") if x in labels})


def mechanism_fields(panel: DataFrame, entity: str = "ticker", horizons=range(2, 9)) -> DataFrame:
    """Guarded leads and lags of returns, imbalance and abnormal turnover that the batteries read.

    ``panel``: entity, week, ret, turnover, non_inst_roi.  Abnormal turnover is the log less its
    trailing mean of eight weeks.
    """
    w, week = W.by(entity, "week"), F.col("week")
    out = panel.withColumn("abn_turnover", W.abnormal(F.col("turnover").cast("double"), w))
    ahead = {"ret_next": W.lead_contiguous(F.col("ret"), week, 1, w), "non_inst_roi_next": W.lead_contiguous(F.col("non_inst_roi"), week, 1, w), "turnover_next": W.lead_contiguous(F.col("abn_turnover"), week, 1, w)}
    ahead |= {f"ret_next_{h}": W.lead_contiguous(F.col("ret"), week, h, w) for h in horizons}
    back = {"ret_lag1": F.lag("ret").over(w), "ret_lag4": W.trailing(F.col("ret"), 4, 2, w), "ret_lag25": W.trailing(F.col("ret"), 25, 12, w), "non_inst_roi_lag1": F.lag("non_inst_roi").over(w), "turnover_lag1": F.lag("abn_turnover").over(w)}
    return out.withColumns(ahead | back)


def weekly_bars(daily: DataFrame, entity: str = "ticker", more: dict[str, Column] | None = None) -> DataFrame:
    """Weekly market rows; first and last skip missing values, sums of nothing are zero.

    ``more``: further aggregates of the same days, by name.
    """
    week = T.week_of(F.col("date"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("date")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date")))
    bars = daily.groupBy(entity, week.alias("week")).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        first("adj_open").alias("week_open"),
        last("adj_close").alias("week_close"),
        F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"),
        F.coalesce(F.sum("value"), F.lit(0)).alias("value"),
        F.avg("amihud").alias("amihud"),
        F.count_if(F.col("volume") == 0).alias("zero_volume_days"),
        *[c.alias(n) for n, c in (more or {}).items()],
    )
    return bars.withColumn("ret", F.try_divide("week_close", "week_open") - 1)


def imbalance(volume: Column, bought: Column, sold: Column) -> Column:
    """((V-B) - (V-S)) / ((V-B) + (V-S)); null if the denominator is not positive."""
    both = (volume - bought) + (volume - sold)
    return F.when(both > 0, ((volume - bought) - (volume - sold)) / both)


def valid_flows(min_volume: int) -> Column:
    """A day whose institutional volumes are known and within a sufficient total."""
    v, b, s = F.col("volume"), F.col("inst_buy"), F.col("inst_sell")
    return (v >= min_volume) & b.isNotNull() & s.isNotNull() & (b <= v) & (s <= v)


def weekly_imbalance(daily: DataFrame, entity: str = "ticker", min_volume: int = 10_000, min_days: int = 3) -> DataFrame:
    """Imbalance of the sums over valid days; null with fewer than ``min_days`` of them."""
    sums = daily.where(valid_flows(min_volume)).groupBy(entity, T.week_of(F.col("date")).alias("week")).agg(F.count(F.lit(1)).alias("n_valid_days"), F.sum("volume").alias("v"), F.sum("inst_buy").alias("b"), F.sum("inst_sell").alias("s"))
    return sums.select(entity, "week", "n_valid_days", F.when(F.col("n_valid_days") >= min_days, imbalance(F.col("v"), F.col("b"), F.col("s"))).alias("roi"))


def lead_lag(panel: DataFrame, entity: str = "ticker", horizons=(1,)) -> DataFrame:
    """Guarded forward returns (adjacent weeks only) and the unguarded lag."""
    w = W.by(entity, "week")
    out = {("ret_next" if h == 1 else f"ret_next_{h}"): W.lead_contiguous(F.col("ret"), F.col("week"), h, w) for h in horizons}
    return panel.withColumns(out | {"ret_lag1": F.lag("ret").over(w), "vol_lag4": W.trailing(F.col("volume"), 4, 2, w), "vol_lag25": W.trailing(F.col("volume"), 25, 12, w)})


def sector_peers(panel: DataFrame, level: str = "att_all", sector: str = "sector") -> DataFrame:
    """Peer mean without the own value: a missing own value counts 0 and still costs one."""
    g = Window.partitionBy(sector, "week")
    total, n = F.coalesce(F.sum(level).over(g), F.lit(0)), F.count(level).over(g)
    peer = F.try_divide(total - F.coalesce(level, F.lit(0)), F.nullif(n - 1, F.lit(0)))
    return panel.withColumns({"sector_total": total, "sector_n": n, "peer_mean": peer, "relative_to_sector": F.col(level) - F.avg(level).over(g)})


def research_panel(cells: DataFrame, counted: DataFrame, bars: DataFrame, entities: DataFrame, entity: str = "ticker") -> DataFrame:
    """Windows first, then the post-listing filter: zeros before listing enter look-backs."""
    full = attention_fields(fill_counts(cells, counted, [entity, "week"]), entity)
    joined = full.join(bars, [entity, "week"], "left").join(entities, entity, "left")
    return joined.where(F.col("week") >= T.week_of(F.col("listing_date")))


def point_in_time_panel(entities: DataFrame, counted: DataFrame, bars: DataFrame, last: Column, entity: str = "ticker") -> DataFrame:
    """Grid from the listing week on: look-backs hold no week before listing."""
    cells = grid(entities, entity, T.week_of(F.col("listing_date")), last)
    full = attention_fields(fill_counts(cells, counted, [entity, "week"]), entity)
    return full.join(bars, [entity, "week"], "left").join(entities, entity, "left")


def bulk_flag(bridge: DataFrame, article: str, entity: str, most: int) -> DataFrame:
    """Rows with the number of entities of their article; more than ``most`` is a bulk listing."""
    own = Window.partitionBy(article)
    # The last of dense ranks counts different entities in the article's own partition, without a join.
    rows = bridge.where(F.col(article).isNotNull()).withColumn("__r", F.when(F.col(entity).isNotNull(), F.dense_rank().over(own.orderBy(F.col(entity).asc_nulls_last()))))
    rows = rows.withColumn("n_entities", F.coalesce(F.max("__r").over(own), F.lit(0)).cast("bigint")).drop("__r")
    return rows.withColumn("is_bulk", F.col("n_entities") > most).select(article, *[c for c in bridge.columns if c != article], "n_entities", "is_bulk")


def bulk_sensitivity(bridge: DataFrame, article: str, thresholds: list[int], entity: str = "ticker") -> DataFrame:
    """threshold, entity, week, att_all: attention rebuilt for every bulk threshold in one pass.

    ``bridge``: article, entity, week.  A mention counts under each threshold that its article's
    number of entities does not exceed.
    """
    rows = bulk_flag(bridge, article, entity, max(thresholds))
    under = F.explode(F.filter(F.array(*[F.lit(k) for k in sorted(thresholds)]), lambda k: F.col("n_entities") <= k)).alias("threshold")
    return rows.select(entity, "week", under).groupBy("threshold", entity, "week").agg(F.count(F.lit(1)).alias("att_all"))


def regime_flags(panel: DataFrame, cutovers: dict[str, str]) -> DataFrame:
    return panel.withColumns({n: (F.col("week") >= F.lit(d).cast("date")) for n, d in cutovers.items()})
