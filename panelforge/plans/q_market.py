"""Adjustment, bars, returns, imbalance, calendar and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import asof, market, panel
from . import base as B
from .registry import query

r6 = lambda c: F.round(c, 6)


@query(B.sql("bars", "SELECT ticker, week, n_days, first_date, last_date, week_open, week_close, volume, round(value, 2) AS value, zero_volume_days, round(ret, 6) AS ret FROM bars"))
def weekly_bars(spark, d):
    return B.bars(spark, d).select("ticker", "week", "n_days", "first_date", "last_date", "week_open", "week_close", "volume", F.round("value", 2).alias("value"), "zero_volume_days", r6("ret").alias("ret"))


@query(B.sql("daily", """SELECT ticker, week, count(*) AS n_valid_days, round(CASE WHEN count(*) >= 2 AND (sum(volume) - sum(inst_buy)) + (sum(volume) - sum(inst_sell)) > 0
    THEN ((sum(volume) - sum(inst_buy)) - (sum(volume) - sum(inst_sell))) / ((sum(volume) - sum(inst_buy)) + (sum(volume) - sum(inst_sell))) END, 6) AS roi
    FROM daily WHERE volume >= 30 AND inst_buy <= volume AND inst_sell <= volume GROUP BY ticker, week"""))
def weekly_roi(spark, d):
    return panel.weekly_imbalance(B.daily(spark, d), min_volume=30, min_days=2).select("ticker", "week", "n_valid_days", r6("roi").alias("roi"))


@query(B.sql("lines", "SELECT ticker, date, " + ", ".join(f"coalesce(sum({a}) FILTER (WHERE flag = '{k}'), 0)::BIGINT AS {a}_{k}" for k in "RAN" for a in ("qty", "cents")) + " FROM lines GROUP BY ticker, date"))
def inst_pivot(spark, d):
    return market.pivot_sums(B.lines(spark, d), ["ticker", "date"], "flag", ["R", "A", "N"], ["qty", "cents"])


@query(B.sql("daily", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE abs(inst_buy - inst_sell - (inst_buy - inst_sell + CASE WHEN volume % 97 = 0 THEN 5 ELSE 0 END)) > 1) AS n_bad, count(*) FILTER (WHERE volume % 97 = 0) / count(*) <= 0.001 AS ok FROM daily"))
def net_reconciliation(spark, d):
    x = B.daily(spark, d).withColumn("net", F.col("inst_buy") - F.col("inst_sell") + F.when(F.col("volume") % 97 == 0, 5).otherwise(0))
    return market.reconcile(x, "inst_buy", "inst_sell", "net")


@query(B.sql("daily", "SELECT ticker, date, nullif(inst_buy, 0) AS inst_buy, nullif(inst_sell, 0) AS inst_sell FROM daily"))
def zero_price_to_null(spark, d):
    return market.zero_to_null(B.daily(spark, d).select("ticker", "date", "inst_buy", "inst_sell"), ["inst_buy", "inst_sell"])


@query(B.sql("adjusted", "SELECT ticker, date, round(factor, 9) AS factor FROM factors"))
def adjustment_factors(spark, d):
    return market.factors(B.events(spark, d)).select("ticker", "date", F.round("factor", 9).alias("factor"))


@query(B.sql("adjusted", "SELECT ticker, date, round(cum_factor * 1e6, 6) / 1e6 AS cum_factor, round(ln(cum_factor), 6) AS log_cum FROM cum").replace("round(cum_factor * 1e6, 6) / 1e6 AS cum_factor, ", ""))
def suffix_cumprod(spark, d):
    x = market.cumulative_factors(market.factors(B.events(spark, d)))
    return x.select("ticker", "date", r6(F.ln("cum_factor")).alias("log_cum"))


@query(B.sql("adjusted", "SELECT ticker, date, round(ln(adj_factor), 6) AS log_factor, round(ln(adj_close), 6) AS log_close, round(ln(adj_open), 6) AS log_open FROM adjusted"))
def adjusted_prices(spark, d):
    return B.adjusted(spark, d).select("ticker", "date", r6(F.ln("adj_factor")).alias("log_factor"), r6(F.ln("adj_close")).alias("log_close"), r6(F.ln("adj_open")).alias("log_open"))


def _samples(spark, d):
    x = B.daily(spark, d).withColumn("m", F.trunc("date", "month"))
    first = x.groupBy("ticker", "m").agg(F.min("date").alias("date"), F.sum("volume").alias("holding")).where(F.month("m") % 2 == 0)
    return first.select("ticker", "date", "holding")


_SAMPLES = "samples AS (SELECT ticker, min(date) AS date, sum(volume)::BIGINT AS holding FROM daily WHERE month(date) % 2 = 0 GROUP BY ticker, date_trunc('month', date))"


@query(B.sql("daily", "SELECT d.ticker, d.date, last_value(holding IGNORE NULLS) OVER (PARTITION BY d.ticker ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS holding FROM daily d LEFT JOIN samples s USING (ticker, date)", _SAMPLES))
def daily_panel_ffill(spark, d):
    return market.fill_samples(B.daily(spark, d), _samples(spark, d), ["holding"]).select("ticker", "date", "holding")


@query(B.sql("daily", """SELECT d.ticker, d.date, coalesce(last_value(holding IGNORE NULLS) OVER (PARTITION BY d.ticker ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(holding IGNORE NULLS) OVER (PARTITION BY d.ticker ORDER BY d.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS holding FROM daily d LEFT JOIN samples s USING (ticker, date)""", _SAMPLES))
def daily_panel_bfill(spark, d):
    return market.fill_samples(B.daily(spark, d), _samples(spark, d), ["holding"], back=True).select("ticker", "date", "holding")


@query(B.sql("bars", "SELECT ticker, date, round(daily_ret, 6) AS daily_ret, round(abs(daily_ret) / nullif(value, 0) * 1e9, 4) AS amihud FROM ret1"))
def daily_return_amihud(spark, d):
    return market.daily_returns(B.plain_prices(B.daily(spark, d))).select("ticker", "date", r6("daily_ret").alias("daily_ret"), F.round("amihud", 4).alias("amihud"))


@query(B.sql("adjusted", """SELECT ticker, n_overlap, round(match_rate, 6) AS match_rate, n_event_days, n_event_divergent, CASE WHEN n_overlap < 100 THEN 'too_few' WHEN match_rate >= 0.98 THEN 'PASS' ELSE 'FAIL' END AS status FROM agg""", """both_ AS (SELECT a.ticker, a.date, abs((a.adj_close / lag(a.adj_close) OVER w) - (a.close / lag(a.close) OVER w)) AS diff, f.factor FROM adjusted a LEFT JOIN factors f USING (ticker, date) WINDOW w AS (PARTITION BY a.ticker ORDER BY a.date)),
agg AS (SELECT ticker, count(*) FILTER (WHERE factor IS NULL) AS n_overlap, avg((diff <= 1e-4)::INT) FILTER (WHERE factor IS NULL) AS match_rate, count(*) FILTER (WHERE factor IS NOT NULL) AS n_event_days, count(*) FILTER (WHERE factor IS NOT NULL AND diff > 1e-4) AS n_event_divergent FROM both_ WHERE diff IS NOT NULL GROUP BY ticker)"""))
def price_validation(spark, d):
    a = B.adjusted(spark, d)
    other = a.select("ticker", "date", F.col("close").alias("adj_close"))
    return market.validate_prices(a, other, market.factors(B.events(spark, d))).withColumn("match_rate", r6("match_rate"))


@query(B.sql("weekly", "SELECT ticker, week, round(ret, 6) AS ret, round(ret_next, 6) AS ret_next, round(ret_lag1, 6) AS ret_lag1 FROM weekly"))
def contiguous_lead_returns(spark, d):
    return B.weekly(spark, d).select("ticker", "week", *[r6(c).alias(c) for c in ("ret", "ret_next", "ret_lag1")])


@query(B.sql("bars", "SELECT ticker, week, " + ", ".join(f"round(CASE WHEN lead(week, {h}) OVER w = week + {7 * h} THEN lead(ret, {h}) OVER w END, 6) AS ret_next_{h}" for h in range(2, 9)) + " FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY week)"))
def forward_horizons_2_8(spark, d):
    x = panel.lead_lag(B.bars(spark, d), horizons=range(2, 9))
    return x.select("ticker", "week", *[r6(f"ret_next_{h}").alias(f"ret_next_{h}") for h in range(2, 9)])


def _trail(x, k, m, agg="avg"):
    f = f"(PARTITION BY ticker ORDER BY week ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) OVER {f} >= {m} THEN {agg}({x}) OVER {f} END"


@query(B.sql("bars", f"SELECT ticker, week, round({_trail('volume', 4, 2)}, 6) AS vol_lag4, round({_trail('volume', 25, 12)}, 6) AS vol_lag25 FROM bars"))
def lagged_rolling_means(spark, d):
    return panel.lead_lag(B.bars(spark, d)).select("ticker", "week", r6("vol_lag4").alias("vol_lag4"), r6("vol_lag25").alias("vol_lag25"))


@query(B.sql("bars", "SELECT ticker, week, " + ", ".join(f"round({_trail('ln(1 + ret)', k, max(2, k // 2), 'sum')}, 6) AS log_mom_{k}w" for k in (4, 12, 26)) + " FROM bars"))
def momentum_4_12_26(spark, d):
    w = W.by("ticker", "week")
    return B.bars(spark, d).select("ticker", "week", *[r6(W.log_momentum(F.col("ret"), k, w)).alias(f"log_mom_{k}w") for k in (4, 12, 26)])


@query(B.sql("bars", f"SELECT ticker, week, round({_trail('ret', 4, 2, 'stddev_samp')}, 6) AS vol_20d, round({_trail('ret', 12, 4, 'stddev_samp')}, 6) AS vol_60d, round(CASE WHEN count(ret) OVER c >= 5 THEN stddev_samp(ret) OVER c END, 6) AS vol_now FROM bars WINDOW c AS (PARTITION BY ticker ORDER BY week ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"))
def rolling_volatility(spark, d):
    w, r = W.by("ticker", "week"), F.col("ret")
    return B.bars(spark, d).select("ticker", "week", r6(W.volatility(r, 4, 2, w)).alias("vol_20d"), r6(W.volatility(r, 12, 4, w)).alias("vol_60d"), r6(W.rolling_volatility_with_current(r, 10, w)).alias("vol_now"))


@query(B.sql("bars", f"SELECT ticker, week, round(volume / nullif({_trail('volume', 4, 2)}, 0), 6) AS rel_volume, round({_trail('zero_volume_days', 4, 2)}, 6) AS zero_days FROM bars"))
def relative_volume(spark, d):
    w, v = W.by("ticker", "week"), F.col("volume")
    return B.bars(spark, d).select("ticker", "week", r6(F.try_divide(v, F.nullif(W.trailing(v, 4, 2, w), F.lit(0.0)))).alias("rel_volume"), r6(W.trailing(F.col("zero_volume_days"), 4, 2, w)).alias("zero_days"))


@query(B.sql("bars", "SELECT ticker, week, row_number() OVER w - 1 AS history, (row_number() OVER w - 1 < 8)::INT AS insufficient FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY week)"))
def history_flags(spark, d):
    n = F.row_number().over(W.by("ticker", "week")) - 1
    return B.bars(spark, d).select("ticker", "week", n.cast("bigint").alias("history"), (n < 8).cast("int").alias("insufficient"))


@query(B.sql("daily", "SELECT ticker, date AS as_of, CASE WHEN n >= 20 THEN round(adv, 4) END AS adv, n AS n_obs FROM (SELECT ticker, date, count(*) OVER w AS n, avg(value) OVER w AS adv FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"))
def adv20_gate(spark, d):
    x = B.daily(spark, d)
    return market.adv_at(x.select("ticker", F.col("date").alias("as_of")), x).select("ticker", "as_of", F.round("adv", 4).alias("adv"), "n_obs")


@query("""WITH ex AS (SELECT n_nationkey AS nation, t AS kind FROM nation, (VALUES ('customer'), ('supplier')) k(t)),
found AS (SELECT c_nationkey AS nation, 'customer' AS kind, count(*) AS n_rows FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier', count(*) FILTER (WHERE s_acctbal > 8000) FROM supplier GROUP BY 1)
SELECT ex.nation, ex.kind, n_rows, CASE WHEN found.nation IS NULL THEN 'MISSING' WHEN coalesce(n_rows, 0) = 0 THEN 'EMPTY' ELSE 'OK' END AS status FROM ex LEFT JOIN found USING (nation, kind)""")
def market_coverage_status(spark, d):
    ex = B.read(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.array(F.lit("customer"), F.lit("supplier"))).alias("kind"))
    c = B.read(spark, d, "customer").where("c_nationkey % 5 <> 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("kind", F.lit("customer"))
    s = B.read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count_if(F.col("s_acctbal") > 8000).alias("n_rows")).withColumn("kind", F.lit("supplier"))
    return market.market_coverage(ex, c.unionByName(s), ["nation", "kind"])


_SCHED = "sched AS (SELECT * FROM (VALUES (DATE '1990-01-01', 0.001425, 0.6, 20.0), (DATE '1997-07-01', 0.001425, 0.5, 15.0), (DATE '2000-01-01', 0.001, 0.5, 10.0)) t(effective_from, fee_rate, fee_discount, slippage_bps))"


@query(B.sql("counted", "SELECT w.week AS as_of, s.effective_from, s.fee_rate::DOUBLE AS fee_rate, s.fee_discount::DOUBLE AS fee_discount, s.slippage_bps::DOUBLE AS slippage_bps FROM (SELECT DISTINCT week FROM counted) w ASOF JOIN sched s ON w.week >= s.effective_from", _SCHED))
def cost_schedule_asof(spark, d):
    from ..operators import backtest

    sched = spark.sql("SELECT CAST(a AS DATE) AS effective_from, CAST(b AS DOUBLE) AS fee_rate, CAST(c AS DOUBLE) AS fee_discount, CAST(s AS DOUBLE) AS slippage_bps FROM VALUES ('1990-01-01', 0.001425, 0.6, 20.0), ('1997-07-01', 0.001425, 0.5, 15.0), ('2000-01-01', 0.001, 0.5, 10.0) AS t(a, b, c, s)")
    return backtest.costs_at(B.counted(spark, d).select(F.col("week").alias("as_of")).distinct(), sched)


@query(B.sql("daily", """SELECT d.ticker, d.date, coalesce(v.venue, 'home') AS venue FROM daily d ASOF LEFT JOIN v ON d.ticker = v.ticker AND d.date >= v.effective_from""", """v AS (SELECT ticker, date AS effective_from, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS effective_to, CASE WHEN volume % 2 = 0 THEN 'A' ELSE 'B' END AS venue FROM daily WHERE volume % 11 = 0)"""))
def venue_validity(spark, d):
    x = B.daily(spark, d)
    w = W.by("ticker", "date")
    v = x.where("volume % 11 = 0").select("ticker", F.col("date").alias("effective_from"), F.lead("date").over(w).alias("effective_to"), F.when(F.col("volume") % 2 == 0, "A").otherwise("B").alias("venue"))
    return asof.valid_at(x.select("ticker", "date", F.lit("home").alias("own")), v, ["ticker"], "date", "effective_from", "effective_to", "venue", "own").select("ticker", "date", "venue")


@query(B.sql("daily", "SELECT week, round(arg_max(c, date) / arg_min(o, date) - 1, 6) AS bench_ret, count(*) AS n_trading_days, min(date) AS first_date, max(date) AS last_date FROM (SELECT date, any_value(week) AS week, sum(cents)::BIGINT / 100.0::DOUBLE / sum(qty)::BIGINT AS c, sum(cents)::BIGINT / 100.0::DOUBLE / sum(qty)::BIGINT AS o FROM lines GROUP BY date) GROUP BY week"))
def benchmark_weekly(spark, d):
    return market.benchmark_weekly(benchmark(spark, d)).withColumn("bench_ret", r6("bench_ret"))


def benchmark(spark, d):
    """All suppliers as one series: value per unit."""
    px = F.sum("cents") / 100.0 / F.sum("qty")
    return B.lines(spark, d).groupBy("date").agg(px.alias("adj_close"), px.alias("adj_open"))
