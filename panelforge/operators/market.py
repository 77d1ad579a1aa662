"""Daily market data: adjustment, returns, liquidity, calendar, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from . import asof

#: Plausible factors by kind of event: above the first, up to the second.
RANGES = {"exright": (0.3, 1.05), "reduction": (1.0, 50.0), "dividend": (0.3, 1.0001)}


def zero_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0).cast(dict(df.dtypes)[c])) for c in cols})


def factors(events: DataFrame, entity: str = "ticker") -> DataFrame:
    """after / before by event, implausible ones dropped, same-day ones multiplied.

    ``events``: entity, date, kind, before_price, after_price.
    """
    f = F.try_divide("after_price", "before_price")
    fine = F.lit(False)
    for kind, (low, high) in RANGES.items():
        upper = f < high if kind == "reduction" else f <= high
        fine = fine | ((F.col("kind") == kind) & (f > low) & upper)
    return events.where(F.coalesce(fine, F.lit(False))).groupBy(entity, "date").agg(F.product(f).alias("factor"))


def cumulative_factors(fac: DataFrame, entity: str = "ticker") -> DataFrame:
    """At every event: the product of its factor and of all later ones."""
    return fac.withColumn("cum_factor", W.suffix_product(F.col("factor"), entity, "date"))


def adjust(daily: DataFrame, fac: DataFrame, entity: str = "ticker") -> DataFrame:
    """adj_factor: product of the factors of events strictly after the day; adjusted prices."""
    cum = cumulative_factors(fac, entity).select(entity, F.col("date").alias("event_date"), "cum_factor")
    out = asof.forward(daily, cum, [entity], "date", "event_date", ["cum_factor"], strict=True)
    out = out.withColumn("adj_factor", F.coalesce("cum_factor", F.lit(1.0))).drop("event_date", "cum_factor")
    return out.withColumns({"adj_close": F.col("close") * F.col("adj_factor"), "adj_open": F.col("open") * F.col("adj_factor")})


def daily_returns(daily: DataFrame, entity: str = "ticker") -> DataFrame:
    """Row-to-row return and Amihud illiquidity (abs return per value, times 1e9)."""
    r = W.pct_change(F.col("adj_close"), W.by(entity, "date"))
    out = daily.withColumn("daily_ret", r)
    return out.withColumn("amihud", F.abs("daily_ret") / F.nullif(F.col("value"), F.lit(0.0)) * 1e9)


def fill_samples(daily: DataFrame, samples: DataFrame, cols: list[str], entity: str = "ticker", back: bool = False) -> DataFrame:
    """Sparse samples joined on the day and carried forward (and back, if asked for)."""
    w = W.by(entity, "date")
    joined = daily.join(samples, [entity, "date"], "left")
    fill = lambda c: F.coalesce(W.ffill(F.col(c), w), W.bfill(F.col(c), entity, "date")) if back else W.ffill(F.col(c), w)
    return joined.withColumns({c: fill(c) for c in cols})


def trading_calendar(daily: DataFrame, least: int = 20, entity: str = "ticker") -> DataFrame:
    """Days on which at least ``least`` entities have a close."""
    days = daily.where("close IS NOT NULL").groupBy("date").agg(F.countDistinct(entity).alias("n_traded"))
    return days.where(F.col("n_traded") >= least).select("date", F.weekday("date").alias("weekday"), (F.weekday("date") == 5).alias("is_makeup_saturday"), "n_traded")


def pivot_sums(long: DataFrame, keys: list[str], kind: str, kinds: list[str], amounts: list[str]) -> DataFrame:
    """Long to wide: one conditional sum per kind and amount; absent ones are 0."""
    return long.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(a))), F.lit(0)).alias(f"{a}_{k}") for k in kinds for a in amounts])


def reconcile(df: DataFrame, bought: str, sold: str, net: str, tolerance: float = 1.0, most: float = 0.001) -> DataFrame:
    """One row: rows, mismatches, share, and whether the share is acceptable."""
    bad = F.abs(F.col(bought) - F.col(sold) - F.col(net)) > tolerance
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad")).withColumn("ok", F.coalesce(F.try_divide("n_bad", "n_rows"), F.lit(0.0)) <= most)


def check_reconciled(df: DataFrame, **kw) -> DataFrame:
    row = reconcile(df, **kw).first()
    if not row["ok"]:
        raise ValueError(f"{row['n_bad']} of {row['n_rows']} rows do not reconcile")
    return df


def validate_prices(own: DataFrame, other: DataFrame, events: DataFrame, entity: str = "ticker", tolerance: float = 1e-4, share: float = 0.98, least: int = 100) -> DataFrame:
    """Per entity: overlap, match rates on event and other days, PASS / FAIL / too_few.

    ``own`` and ``other``: entity, date, adj_close; compared as daily returns.
    """
    w = W.by(entity, "date")
    both = own.select(entity, "date", F.col("adj_close").alias("__a")).join(other.select(entity, "date", F.col("adj_close").alias("__b")), [entity, "date"])
    both = both.join(events.select(entity, "date").distinct().withColumn("__event", F.lit(True)), [entity, "date"], "left")
    diff = F.abs(W.pct_change(F.col("__a"), w) - W.pct_change(F.col("__b"), w))
    rows = both.withColumn("__diff", diff).where("__diff IS NOT NULL")
    calm = F.col("__event").isNull()
    out = rows.groupBy(entity).agg(
        F.count_if(calm).alias("n_overlap"),
        F.avg(F.when(calm, (F.col("__diff") <= tolerance).cast("double"))).alias("match_rate"),
        F.count_if(~calm).alias("n_event_days"),
        F.count_if(~calm & (F.col("__diff") > tolerance)).alias("n_event_divergent"),
    )
    return out.withColumn("status", F.when(F.col("n_overlap") < least, "too_few").when(F.col("match_rate") >= share, "PASS").otherwise("FAIL"))


def market_coverage(expected: DataFrame, found: DataFrame, keys: list[str], rows: str = "n_rows") -> DataFrame:
    """OK / EMPTY / MISSING of every expected key."""
    out = expected.join(found.withColumn("__there", F.lit(True)), keys, "left")
    status = F.when(F.col("__there").isNull(), "MISSING").when(F.coalesce(rows, F.lit(0)) == 0, "EMPTY").otherwise("OK")
    return out.withColumn("status", status).drop("__there")


def trailing_value(daily: DataFrame, n: int = 20, entity: str = "ticker") -> DataFrame:
    """Mean value and count of the last ``n`` rows up to and with each day (for use strictly after it)."""
    w = W.by(entity, "date").rowsBetween(1 - n, 0)
    return daily.withColumns({"n_obs": F.count(F.lit(1)).over(w), "adv": F.avg("value").over(w)})


def adv_at(asked: DataFrame, daily: DataFrame, n: int = 20, entity: str = "ticker", at: str = "as_of") -> DataFrame:
    """Mean value of the last ``n`` sessions strictly before ``at``; null with fewer."""
    base = trailing_value(daily, n, entity).select(entity, F.col("date").alias("adv_date"), "n_obs", "adv")
    out = asof.backward(asked, base, [entity], at, "adv_date", ["n_obs", "adv"], strict=True)
    return out.withColumns({"n_obs": F.coalesce("n_obs", F.lit(0)), "adv": F.when(F.col("n_obs") >= n, F.col("adv"))}).drop("adv_date")


def benchmark_weekly(daily: DataFrame) -> DataFrame:
    """week, bench_ret, n_trading_days, first_date, last_date of one series (date, adj_open, adj_close)."""
    from ..functions.timeops import week_of

    o = F.min_by("adj_open", F.when(F.col("adj_open").isNotNull(), F.col("date")))
    c = F.max_by("adj_close", F.when(F.col("adj_close").isNotNull(), F.col("date")))
    return daily.groupBy(week_of(F.col("date")).alias("week")).agg((F.try_divide(c, o) - 1).alias("bench_ret"), F.count(F.lit(1)).alias("n_trading_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
