"""Forecast data: features, labels, folds, universe snapshots, supplemental sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeops as T
from ..functions import windows as W
from . import asof


# ---- Fixed values: which features a set may use, and what may never be one.
FEATURES = {
    "A": (
        "ret", "ret_lag1", "mom_4w", "mom_12w", "mom_26w", "vol_20d", "vol_60d", "log_adv20", "rel_volume_1w", "amihud_20d",
        "zero_volume_share_20d", "mean_turnover_20d", "log_market_cap", "listing_age_years", "foreign_holding_pct",
        "bench_ret_1w", "bench_vol_20d", "missing_market_cap", "missing_foreign_holding", "missing_amihud", "history_weeks_available",
    ),
    "attention": (
        "log1p_att_all", "log1p_att_weekday", "log1p_att_weekend", "abn_attention_all", "abn_attention_weekday", "abn_attention_weekend",
        "att_count_delta_1w", "att_count_trend_4w", "att_nonzero_weeks_52", "att_mean_level_52", "history_weeks_available",
        "insufficient_history", "is_initiation", "att_zero_base", "log1p_att_high_effort", "log1p_att_mid_effort",
        "log1p_att_low_effort", "weekend_share", "non_trading_share", "is_code_only_matched", "missing_attention_window",
    ),
    "news": ("log1p_news_count_1w", "log1p_news_count_4w", "missing_news"),
    "revenue": ("revenue_yoy_latest", "revenue_mom_latest", "log_revenue_latest", "days_since_revenue_announce", "missing_revenue"),
}
FORBIDDEN = (
    "ret_next", "non_inst_roi_next", "turnover_next", "ret_fwd2", "ret_fwd3", "ret_fwd4", "ret_fwd5", "ret_fwd6", "ret_fwd7", "ret_fwd8",
    "y_excess_1w", "y_excess_4w", "y_outperform_1w", "y_stock_1w", "y_bench_1w", "label_status",
)
SETS = {"A": ("A",), "B": ("A", "attention"), "C": ("A", "news"), "D": ("A", "revenue"), "E": ("A", "revenue", "attention")}
# ---- End of the fixed values.


def feature_set(name: str) -> list[str]:
    """The features of a set, each once."""
    return list(dict.fromkeys(f for part in SETS[name.upper()] for f in FEATURES[part]))


def check_columns(cols: list[str], allowed: set[str] | None = None, forbidden: set[str] = frozenset()) -> list[str]:
    """Feature names, guarded: none forbidden, none outside the whitelist."""
    bad = set(cols) & set(forbidden) | (set(cols) - set(allowed) if allowed is not None else set())
    if bad:
        raise ValueError(f"not allowed as features: {sorted(bad)}")
    return list(dict.fromkeys(cols))


def engineer(panel: DataFrame, bench: DataFrame | None = None, entity: str = "ticker") -> DataFrame:
    """All price, liquidity, history and attention features in one window pass.

    Inputs that the panel does not have (market value, turnover, foreign holding, counts by
    window and effort) give features without a value, so a feature set is always complete.
    """
    w, have = W.by(entity, "week"), set(panel.columns)
    col = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    r, v, a = F.col("ret"), F.col("value"), F.col("att_all").cast("double")
    past, some = W.trailing(v, 4, 2, w), F.nullif(a, F.lit(0.0))
    age = F.row_number().over(w) - 1
    missing = lambda c: col(c).isNull().cast("int")
    out = panel.withColumns(
        {
            **{f"mom_{k}w": W.momentum(r, k, w) for k in (4, 12, 26)},
            "log_adv20": F.when(v > 0, F.ln(v)),
            "log_market_cap": F.when(col("market_cap") > 0, F.ln(col("market_cap"))),
            "rel_volume_1w": F.try_divide(v, F.nullif(past, F.lit(0.0))),
            "vol_20d": W.volatility(r, 4, 2, w),
            "vol_60d": W.volatility(r, 12, 4, w),
            "amihud_20d": W.trailing(F.col("amihud"), 4, 2, w),
            "zero_volume_share_20d": W.trailing(F.col("zero_volume_days"), 4, 2, w),
            "mean_turnover_20d": W.trailing(col("turnover"), 4, 2, w),
            "history_weeks_available": age,
            "insufficient_history": (age < 8).cast("int"),
            **{f"log1p_{c}": F.log1p(col(c)) for c in ("att_all", "att_weekday", "att_weekend", "att_high_effort", "att_mid_effort", "att_low_effort")},
            "att_count_delta_1w": a - F.lag(a).over(w),
            "att_count_trend_4w": a - W.trailing(a, 4, 2, w),
            "weekend_share": F.try_divide(col("att_weekend"), some),
            "non_trading_share": F.try_divide(col("att_non_trading"), some),
            "missing_attention_window": F.coalesce((a == 0) | a.isNull(), F.lit(True)).cast("int"),
            "missing_market_cap": missing("market_cap"),
            "missing_foreign_holding": missing("foreign_holding_pct"),
            "missing_amihud": missing("amihud"),
            "is_code_only_matched": F.coalesce(col("is_code_only_matched").cast("int"), F.lit(0)),
        }
    )
    if "foreign_holding_pct" not in have:
        out = out.withColumn("foreign_holding_pct", col("foreign_holding_pct"))
    if "listing_age_years" not in have:
        age_years = T.age_years(F.col("listing_date"), F.col("week")) if "listing_date" in have else F.lit(None).cast("double")
        out = out.withColumn("listing_age_years", age_years)
    warm = [c for c in have if c.startswith("abn_att")]
    out = out.withColumns({c: F.when(F.col("insufficient_history") == 0, F.col(c)) for c in warm}) if warm else out
    if bench is not None:
        bw = Window.orderBy("week")  # one row a week
        state = bench.select("week", F.col("bench_ret").alias("bench_ret_1w"), W.volatility(F.col("bench_ret"), 4, 2, bw).alias("bench_vol_20d"))
        out = out.join(F.broadcast(state), "week", "left")
    return out


def attach_sources(rows: DataFrame, news: DataFrame | None = None, revenue: DataFrame | None = None, entity: str = "ticker") -> DataFrame:
    """``rows`` (entity, as_of) with the supplemental features of both sources under their names in the sets.

    ``news``: entity, publish_at; ``revenue``: entity, announce_date, revenue, revenue_yoy,
    revenue_mom.  A source that is absent or empty gives no values and says that it is missing;
    with news at hand, no item means a count of zero.
    """
    none = F.lit(None).cast("double")
    if news is None or news.isEmpty():
        out = rows.withColumns({"log1p_news_count_1w": none, "log1p_news_count_4w": none, "missing_news": F.lit(1)})
    else:
        out = news_counts(rows, news, entity).drop("news_count_1w", "news_count_4w").withColumn("missing_news", F.lit(0))
    if revenue is None or revenue.isEmpty():
        return out.withColumns({**{c: none for c in ("revenue_yoy_latest", "revenue_mom_latest", "log_revenue_latest")}, "days_since_revenue_announce": F.lit(None).cast("int"), "missing_revenue": F.lit(1)})
    out = revenue_features(out, revenue, entity)
    named = {"revenue_yoy_latest": W.finite(F.col("revenue_yoy").cast("double")), "revenue_mom_latest": W.finite(F.col("revenue_mom").cast("double")), "log_revenue_latest": W.finite(F.col("log_revenue_latest"))}
    return out.withColumns(named).withColumnRenamed("days_since_announce", "days_since_revenue_announce").drop("revenue", "revenue_yoy", "revenue_mom", "announce_date")


def feature_matrix(rows: DataFrame, name: str, keys: tuple[str, ...] = ("ticker", "week")) -> DataFrame:
    """``keys`` and the columns of a feature set, guarded by the whitelist and the forbidden names."""
    cols = check_columns(feature_set(name), {f for part in FEATURES.values() for f in part}, set(FORBIDDEN))
    absent = [c for c in cols if c not in rows.columns]
    if absent:
        raise ValueError(f"features not built: {absent}")
    return rows.select(*keys, *cols)


# ------------------------------------------------------------------ labels
def entry_exit(weeks: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """entry_at: first session of the next week; label_end_at: last session up to ``horizon`` weeks on."""
    b = asof.calendar_bounds(calendar)
    nxt = b.select(F.date_sub("week", 7).alias("week"), F.col("first_date").alias("entry_at"))
    rows = weeks.join(F.broadcast(nxt), "week", "left")
    ends = b.select(F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k"), F.col("week").alias("__w"), "last_date").select(F.date_sub("__w", F.col("k") * 7).alias("week"), "last_date")
    last = ends.groupBy("week").agg(F.max("last_date").alias("label_end_at"))
    return rows.join(F.broadcast(last), "week", "left")


def labels(panel: DataFrame, daily: DataFrame, calendar: DataFrame, bench: DataFrame, horizon: int = 1, entity: str = "ticker", weeks: DataFrame | None = None) -> DataFrame:
    """Holding returns from entry to exit, in excess of the benchmark, with their status.

    ``bench``: date, adj_open, adj_close of one series.  ``weeks``: the panel's distinct weeks,
    where they are known from less than the panel.
    """
    weeks = entry_exit(panel.select("week").distinct() if weeks is None else weeks, calendar, horizon)
    rows = panel.select(entity, "week").join(F.broadcast(weeks), "week")
    own = asof.range_first_last(rows.dropna(subset=["entry_at", "label_end_at"]), daily, entity, "entry_at", "label_end_at")
    b = bench.select(F.lit("b").alias("__b"), "date", "adj_open", "adj_close")
    spans = weeks.dropna(subset=["entry_at", "label_end_at"]).select(F.lit("b").alias("__b"), "entry_at", "label_end_at").distinct()
    base = asof.range_first_last(spans, b, "__b", "entry_at", "label_end_at").select("entry_at", "label_end_at", F.col("period_ret").alias("bench_period_ret"))
    out = rows.join(own, [entity, "entry_at", "label_end_at"], "left").join(F.broadcast(base), ["entry_at", "label_end_at"], "left")
    y = F.col("period_ret") - F.col("bench_period_ret")
    status = label_status(F.col("entry_at"), F.col("label_end_at"), F.col("period_ret"), F.col("bench_period_ret"), y)
    return out.select(entity, "week", T.as_of(F.col("week")).alias("as_of"), "entry_at", "label_end_at", T.available_at(F.col("label_end_at")).alias("label_available_at"), F.col("period_ret").alias("y_ret"), y.alias("y_excess"), (y > 0).cast("int").alias("y_outperform"), status.alias("label_status"))


def panel_labels(built: DataFrame, panel: DataFrame, bench_weekly: DataFrame, entity: str = "ticker") -> DataFrame:
    """One-week labels whose returns are those of the panel; dates and status stay as built.

    ``panel``: entity, week, ret_next; ``bench_weekly``: week, bench_ret.  A status may thus say
    ``ok`` where the panel has no next return, and the other way round: a quirk that is kept.
    """
    own = panel.select(entity, "week", F.col("ret_next").alias("y_ret"))
    base = bench_weekly.select(F.date_sub("week", 7).alias("week"), F.col("bench_ret").alias("__b"))
    out = built.drop("y_ret", "y_excess", "y_outperform").join(own, [entity, "week"], "left").join(F.broadcast(base), "week", "left")
    y = F.col("y_ret") - F.col("__b")
    return out.withColumns({"y_excess": y, "y_outperform": (y > 0).cast("int")}).drop("__b")


def label_status(entry: Column, end: Column, own: Column, bench: Column, y: Column) -> Column:
    return F.when(entry.isNull() | end.isNull(), "schedule_skip").when(own.isNull(), "entry_unavailable_or_missing_stock").when(bench.isNull(), "benchmark_missing").when(y.isNull(), "label_missing").otherwise("ok")


def mature(xy: DataFrame, cutoff, y: str = "y_excess") -> DataFrame:
    """Rows whose label was known before ``cutoff``."""
    c = F.lit(cutoff).cast("date")
    return xy.where((F.col("label_end_at") < c) & (F.col("label_available_at") < c) & (F.col("label_status") == "ok") & F.col(y).isNotNull() & (F.col("as_of") < c))


def usable(df: DataFrame, at: Column) -> DataFrame:
    return df.where((F.col("event_at") < at) & (F.col("available_at") < at))


def year_plans(spark, years: list[int]) -> DataFrame:
    """outer_year, train_cutoff (first Monday of the year), end (first day of the next)."""
    rows = spark.createDataFrame([(y,) for y in years], "outer_year int")
    return rows.select("outer_year", T.first_monday(F.col("outer_year")).alias("train_cutoff"), F.make_date(F.col("outer_year"), F.lit(1), F.lit(1)).alias("start"), F.make_date(F.col("outer_year") + 1, F.lit(1), F.lit(1)).alias("end"))


def folds(xy: DataFrame, years: list[int], horizon: str = "1w", tiers: list[str] | None = None, y: str = "y_excess", entity: str = "ticker") -> DataFrame:
    """Train pools before each year's cutoff and the year's test rows with their reasons."""
    rows = xy.where(F.col("sparsity_tier").isin(*tiers)) if tiers else xy
    role = lambda split, year, reason: F.struct(F.lit(split).alias("split"), F.lit(year).alias("outer_year"), reason.alias("exclude_reason"))
    why = F.when(F.coalesce(F.col("label_status"), F.lit("")) != "ok", F.coalesce("label_status", F.lit("label_not_ok"))).when(F.col(y).isNull(), "label_immature_or_missing").otherwise("")
    # The years are few: each row says which of them it trains and which it tests, without a join.
    roles = []
    for year in years:
        c = T.first_monday(F.lit(year))
        known = (F.col("label_status") == "ok") & F.col(y).isNotNull() & (F.col("label_end_at") < c) & (F.col("label_available_at") < c) & (F.col("as_of") < c)
        roles += [F.when(known, role("train", year, F.lit(""))), F.when(F.year("as_of") == year, role("test", year, why))]
    met = rows.select("as_of", entity, F.explode(F.array_compact(F.array(*roles))).alias("role"))
    return met.select(F.concat(F.lit("outer_"), F.col("role.outer_year")).alias("fold_id"), "as_of", entity, F.lit(horizon).alias("horizon"), "role.split", "role.exclude_reason", "role.outer_year")


def inner_blocks(weeks: list[dt.date], n_blocks: int = 3, size: int = 26, least: int = 104) -> list[tuple[dt.date, dt.date, dt.date]]:
    """Forward validation blocks at the end of the sample: (train before, first, last)."""
    weeks, out = sorted(set(weeks)), []
    for b in range(n_blocks, 0, -1):
        start = len(weeks) - b * size
        if start >= least:
            out.append((weeks[start], weeks[start], weeks[min(len(weeks), start + size) - 1]))
    return out


# ------------------------------------------------------------------ universe and sources
def members(universe: DataFrame, venues: DataFrame, at: DataFrame, entity: str = "ticker") -> DataFrame:
    """Status and venue of every entity at every as_of (``at``: as_of, one row a date)."""
    rows = universe.crossJoin(F.broadcast(at.select("as_of").distinct()))  # dates are few: one a snapshot
    status = F.when(F.col("listing_date") > F.col("as_of"), "pre_listing").when(F.col("delisting_date") <= F.col("as_of"), "delisted").otherwise("active")
    rows = rows.withColumn("status", status).withColumnRenamed("venue", "__own")
    return asof.valid_at(rows, venues, [entity], "as_of", "effective_from", "effective_to", "venue", "__own").drop("__own")


def revenue_rates(monthly: DataFrame, entity: str = "ticker") -> DataFrame:
    """Year-on-year and month-on-month by row where the source has none."""
    w = W.by(entity, "month")
    return monthly.withColumns({"revenue_yoy": W.pct_change(F.col("revenue"), w, 12), "revenue_mom": W.pct_change(F.col("revenue"), w, 1)})


def revenue_features(rows: DataFrame, revenue: DataFrame, entity: str = "ticker") -> DataFrame:
    """Latest announcement strictly before as_of."""
    out = asof.backward(rows, revenue, [entity], "as_of", "announce_date", ["revenue", "revenue_yoy", "revenue_mom"], strict=True)
    return out.withColumns({"log_revenue_latest": F.when(F.col("revenue") > 0, F.ln("revenue")), "days_since_announce": F.datediff("as_of", "announce_date"), "missing_revenue": F.col("revenue_yoy").isNull().cast("int")})


def news_counts(rows: DataFrame, news: DataFrame, entity: str = "ticker", end_inclusive: bool = True) -> DataFrame:
    """Items of 1 and 4 weeks up to Sunday 00:00 before as_of (the rest of Sunday is not counted).

    Every item is exploded to the four weeks whose window may hold it and aggregated, so
    the join is an equi join.
    """
    t = F.col("publish_at")
    day = F.to_date(t)
    # Sunday midnight itself belongs to the week that it ends.
    ends = T.week_of(F.when(F.date_trunc("day", t).cast("timestamp_ntz") == t.cast("timestamp_ntz"), day).otherwise(F.date_add(day, 1))) if end_inclusive else T.week_of(F.date_add(day, 1))
    lag = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")
    items = news.select(entity, t.alias("t"), ends.alias("e"), lag).select(entity, "t", F.date_add("e", F.col("k") * 7).alias("end"))
    start = lambda n: F.date_sub("end", n).cast("timestamp_ntz")
    sums = items.groupBy(entity, "end").agg(F.count_if(F.col("t") >= start(6)).alias("news_count_1w"), F.count_if(F.col("t") >= start(27)).alias("news_count_4w"))
    out = rows.withColumn("end", F.date_sub("as_of", 1)).join(sums, [entity, "end"], "left").drop("end").fillna(0, ["news_count_1w", "news_count_4w"])
    return out.withColumns({"log1p_news_count_1w": F.log1p("news_count_1w"), "log1p_news_count_4w": F.log1p("news_count_4w")})


def first_listed_dates(events: DataFrame, entity: str, day: Column) -> DataFrame:
    return events.groupBy(entity).agg(F.min(day).alias("listing_date"))
