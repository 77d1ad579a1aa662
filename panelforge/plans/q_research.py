"""Report tables, portfolios, event paths, matching, estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import absorb
from ..operators import estimators as E
from ..operators import research as R
from . import base as B
from .registry import query

r6 = lambda c: F.round(c, 6)
_VARS = ["att_all", "abn_att_all", "ret", "volume"]


@query(B.sql("weekly", " UNION ALL ".join(f"SELECT '{c}' AS control, round(avg(({c} IS NOT NULL)::INT), 6) AS share, avg(({c} IS NOT NULL)::INT) >= 0.97 AS available FROM weekly" for c in _VARS)))
def controls_coverage(spark, d):
    return R.control_shares(B.weekly(spark, d), _VARS, 0.97).withColumn("share", r6("share"))


@query(B.sql("weekly", " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, round(count({c}) / count(*), 6) AS share, count(DISTINCT CASE WHEN {c} IS NOT NULL THEN ticker END) AS n_entities FROM weekly" for c in _VARS)))
def full_coverage(spark, d):
    return R.coverage(B.weekly(spark, d), _VARS, "ticker").withColumn("share", r6("share"))


@query(B.sql("weekly", " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, round(1 - count({c}) / count(*), 6) AS missing_share, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(min({c})::DOUBLE, 6) AS min, round(quantile_cont({c}::DOUBLE, 0.01), 6) AS p1, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, round(quantile_cont({c}::DOUBLE, 0.99), 6) AS p99, round(max({c})::DOUBLE, 6) AS max FROM weekly" for c in _VARS)))
def descriptive_stats(spark, d):
    x = R.describe(B.weekly(spark, d), _VARS)
    return x.select("variable", "n", *[r6(c).alias(c) for c in x.columns[2:]])


@query(B.sql("counted", "SELECT count(*) AS n, round(corr(att_all, att_weekday), 6) AS all_weekday, round(corr(att_all, att_weekend), 6) AS all_weekend, round(corr(ln(1 + att_weekday), ln(1 + att_weekend)), 6) AS log_weekday_weekend FROM counted"))
def window_correlations(spark, d):
    return B.counted(spark, d).agg(F.count(F.lit(1)).alias("n"), r6(W.safe_corr("att_all", "att_weekday")).alias("all_weekday"), r6(W.safe_corr("att_all", "att_weekend")).alias("all_weekend"), r6(W.safe_corr(F.log1p("att_weekday"), F.log1p("att_weekend"))).alias("log_weekday_weekend"))


@query(B.sql("weekly", "SELECT sector, count(*) AS n_rows, count(DISTINCT ticker) AS n_entities, count(*) FILTER (WHERE sparsity_tier = 'dense') AS n_dense, count(*) FILTER (WHERE sparsity_tier = 'sparse') AS n_sparse, count(*) FILTER (WHERE sparsity_tier = 'silent') AS n_silent, round(avg((att_all = 0)::INT), 6) AS zero_share FROM weekly GROUP BY sector"))
def sector_coverage(spark, d):
    x = B.weekly(spark, d)
    p = R.pivot_counts(x, "sector", "sparsity_tier", ["dense", "sparse", "silent"])
    return x.groupBy("sector").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ticker").alias("n_entities"), r6(F.avg((F.col("att_all") == 0).cast("double"))).alias("zero_share")).join(p, "sector")


@query(B.sql("lines", "SELECT ticker, count(*) FILTER (WHERE flag = 'R') AS \"n_R\", count(*) FILTER (WHERE flag = 'A') AS \"n_A\", count(*) FILTER (WHERE flag = 'N') AS \"n_N\" FROM lines GROUP BY ticker"))
def collision_mode_pivot(spark, d):
    return R.pivot_counts(B.lines(spark, d), "ticker", "flag", ["R", "A", "N"])


@query(B.sql("lines", "SELECT strftime(date, '%Y-%m') AS month, count(*) AS n_rows, count(DISTINCT article) AS n_articles, count(DISTINCT ticker) AS n_entities, round(avg((isodow(date) >= 6)::INT), 6) AS weekend_share FROM lines GROUP BY 1"))
def coverage_monthly(spark, d):
    return B.lines(spark, d).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("article").alias("n_articles"), F.countDistinct("ticker").alias("n_entities"), r6(F.avg((F.weekday("date") >= 5).cast("double"))).alias("weekend_share"))


@query(B.sql("lines", "SELECT s_suppkey AS ticker, s_nationkey AS sector, min(date) AS first_seen, count(date) AS n_rows, CASE WHEN count(date) = 0 THEN 'never' WHEN min(date) > DATE '1995-03-01' THEN 'late' ELSE 'from_start' END AS status FROM supplier LEFT JOIN lines ON s_suppkey = ticker GROUP BY ALL"))
def listing_reconciliation(spark, d):
    s = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("sector"))
    seen = B.lines(spark, d).groupBy("ticker").agg(F.min("date").alias("first_seen"), F.count(F.lit(1)).alias("n_rows"))
    return s.join(seen, "ticker", "left").select("ticker", "sector", "first_seen", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.when(F.col("n_rows").isNull(), "never").when(F.col("first_seen") > F.lit("1995-03-01").cast("date"), "late").otherwise("from_start").alias("status"))


_POWER = """st AS (SELECT ticker, corr(att_high, att_low) AS corr, count(*) FILTER (WHERE att_high > 0) AS weeks_a, count(*) FILTER (WHERE att_low > 0) AS weeks_b, sum(att_high)::BIGINT AS n_a, sum(att_low)::BIGINT AS n_b FROM filled GROUP BY ticker)"""


@query(B.sql("attention", "SELECT ticker, round(corr, 6) AS corr, weeks_a, weeks_b, n_a, n_b, n_a >= 30 AND n_b >= 30 AND weeks_a >= 15 AND weeks_b >= 15 AS powered, CASE WHEN NOT (n_a >= 30 AND n_b >= 30 AND weeks_a >= 15 AND weeks_b >= 15) THEN 'insufficient_power' WHEN corr >= 0.02 THEN 'pass' ELSE 'fail' END AS status FROM st", _POWER))
def code_name_corr_powered(spark, d):
    return _powered(spark, d).withColumn("corr", r6("corr"))


def _powered(spark, d):
    a = B.attention(spark, d)
    n = a.groupBy("ticker").agg(F.sum("att_high").alias("n_a"), F.sum("att_low").alias("n_b"))
    return R.powered_correlation(a, n, "att_high", "att_low", least_corr=0.02)


@query(B.sql("attention", """SELECT coalesce(st.ticker, s.s_suppkey) AS ticker, CASE WHEN NOT coalesce(n_a + n_b > 300, false) THEN 'C' WHEN coalesce(n_a >= 30 AND n_b >= 30 AND weeks_a >= 15 AND weeks_b >= 15 AND corr < 0.02, false) OR coalesce(s_acctbal < 0, false) THEN 'B' WHEN NOT coalesce(n_a >= 30 AND n_b >= 30 AND weeks_a >= 15 AND weeks_b >= 15, false) THEN 'D' ELSE 'A' END AS tier FROM st FULL JOIN supplier s ON st.ticker = s.s_suppkey""", _POWER))
def screen_quality_tiers(spark, d):
    s = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"), (F.col("s_acctbal") < 0).alias("code_only"))
    x = _powered(spark, d).join(s, "ticker", "full")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return x.select("ticker", R.quality_tier(yes(F.col("n_a") + F.col("n_b") > 300), yes(F.col("status") == "fail"), yes(F.col("code_only")), yes(F.col("powered"))).alias("tier"))


@query(B.sql("weekly", "SELECT sparsity_tier, least(count(*), 50) AS n FROM weekly WHERE sparsity_tier IS NOT NULL GROUP BY sparsity_tier"))
def stratified_sample_sizes(spark, d):
    x = B.weekly(spark, d).where("sparsity_tier IS NOT NULL").withColumn("key", F.concat_ws("|", "ticker", "week"))
    return R.stratified_sample(x, "sparsity_tier", "key", 50).groupBy("sparsity_tier").agg(F.count(F.lit(1)).alias("n"))


_Z = "(ret - avg(ret) OVER t) / nullif(stddev_samp(ret) OVER t, 0)"


@query(B.sql("weekly", f"SELECT ticker, week, sparsity_tier, round({_Z}, 6) AS z_ret FROM weekly WHERE sparsity_tier IS NOT NULL WINDOW t AS (PARTITION BY sparsity_tier)"))
def standardize_within_tier(spark, d):
    return R.standardise(B.weekly(spark, d).select("ticker", "week", "sparsity_tier", "ret"), ["ret"], ["sparsity_tier"]).select("ticker", "week", "sparsity_tier", r6("z_ret").alias("z_ret"))


@query(B.sql("bars", "SELECT ticker, week, round(greatest(least(ret, hi), lo), 6) AS ret_w FROM bars, (SELECT quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM bars)"))
def winsorize(spark, d):
    return R.winsorise(B.bars(spark, d), "ret").select("ticker", "week", r6("ret_w").alias("ret_w"))


_XY = "xy AS (SELECT week, ret_next AS y, att_all::DOUBLE AS x FROM weekly WHERE ret_next IS NOT NULL), sl AS (SELECT week, regr_slope(y, x) AS b FROM xy GROUP BY week HAVING count(*) >= 20 AND regr_slope(y, x) IS NOT NULL AND NOT isnan(regr_slope(y, x)))"
_NW = "e AS (SELECT week, b, b - avg(b) OVER () AS e FROM sl), l AS (SELECT " + ", ".join(f"coalesce(sum(e * e{k}), 0) AS s{k}" for k in range(5)) + ", count(*) AS n, avg(b) AS mean FROM (SELECT b, e, e AS e0, " + ", ".join(f"lag(e, {k}) OVER (ORDER BY week) AS e{k}" for k in range(1, 5)) + " FROM e))"
_NWSE = "sqrt(s0 + 2 * (0.8 * s1 + 0.6 * s2 + 0.4 * s3 + 0.2 * s4)) / n"


@query(B.sql("weekly", f"SELECT 'att_all' AS term, n, round(mean, 6) AS mean, round({_NWSE}, 6) AS se, round(mean / nullif({_NWSE}, 0), 4) AS t FROM l", _XY, _NW))
def fama_macbeth_univariate(spark, d):
    x = B.weekly(spark, d).withColumn("att_all", F.col("att_all").cast("double"))
    return E.fama_macbeth(x, "ret_next", ["att_all"]).select("term", "n", r6("mean").alias("mean"), r6("se").alias("se"), F.round("t", 4).alias("t"))


@query(B.sql("bars", f"SELECT n, round(mean, 6) AS mean, round({_NWSE}, 6) AS se, round(mean / nullif({_NWSE}, 0), 4) AS t FROM l", "sl AS (SELECT week, avg(ret) AS b FROM bars GROUP BY week)", _NW))
def newey_west_mean(spark, d):
    weekly = B.bars(spark, d).groupBy("week").agg(F.avg("ret").alias("b"))
    return E.newey_west(weekly, "b", "week").select("n", r6("mean").alias("mean"), r6("se").alias("se"), F.round("t", 4).alias("t"))


@query(B.sql("attention", """SELECT round(sum(x * y) / sum(x * x), 6) AS beta, count(*) AS n FROM (SELECT att_all - avg(att_all) OVER i - avg(att_all) OVER t + avg(att_all) OVER () AS x, att_high - avg(att_high) OVER i - avg(att_high) OVER t + avg(att_high) OVER () AS y FROM filled WINDOW i AS (PARTITION BY ticker), t AS (PARTITION BY week))"""))
def balanced_twoway_fe_beta(spark, d):
    x = B.attention(spark, d).select("ticker", "week", F.col("att_all").cast("double").alias("x"), F.col("att_high").cast("double").alias("y"))
    dm = absorb.demeaned(x, ["x", "y"])
    return dm.agg(r6(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("beta"), F.count(F.lit(1)).alias("n"))


@query(B.sql("weekly", "SELECT ticker, week, round(ret, 6) AS ret, volume, row_number() OVER (ORDER BY sparsity_tier ASC NULLS FIRST, ret DESC NULLS LAST, week ASC NULLS LAST, ticker ASC NULLS LAST) AS place FROM weekly QUALIFY place <= 200"))
def top_by_tier_and_return(spark, d):
    """Two hundred rows: those without a tier first, then by tier; the best returns first, missing ones last."""
    keys = [("sparsity_tier", False, True), ("ret", True, False), ("week", False, False), ("ticker", False, False)]
    return R.top_rows(B.weekly(spark, d), keys, 200).select("ticker", "week", r6("ret").alias("ret"), "volume", "place")


@query(B.sql("weekly", "SELECT ticker, count(*) AS n, round(regr_slope(ret_next, att_all), 6) AS slope, round(regr_intercept(ret_next, att_all), 6) AS intercept FROM weekly WHERE ret_next IS NOT NULL GROUP BY ticker HAVING count(*) >= 30"))
def ols_by_entity(spark, d):
    return E.slopes(B.weekly(spark, d), "ret_next", "att_all", ["ticker"], 30).select("ticker", "n", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query(B.sql("weekly", """SELECT week, bucket, count(*) AS n, round(avg(ret_next), 6) AS r FROM (SELECT w.*, CASE WHEN v <= q1 THEN 1 WHEN v <= q2 THEN 2 ELSE 3 END AS bucket FROM (SELECT *, volume::DOUBLE AS v FROM weekly WHERE ret_next IS NOT NULL AND volume IS NOT NULL) w
    JOIN (SELECT week, quantile_cont(volume::DOUBLE, 1.0/3) AS q1, quantile_cont(volume::DOUBLE, 2.0/3) AS q2, min(volume) AS q0, max(volume) AS q3 FROM weekly WHERE ret_next IS NOT NULL AND volume IS NOT NULL GROUP BY week) q USING (week) WHERE q0 < q1 AND q1 < q2 AND q2 < q3) GROUP BY week, bucket"""))
def tercile_by_week(spark, d):
    """Value terciles: ties stay together; weeks with equal edges have none."""
    x = R.weekly_terciles(B.weekly(spark, d).dropna(subset=["ret_next", "volume"]), "volume").where("bucket IS NOT NULL")
    return x.groupBy("week", "bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ret_next")).alias("r"))


# ------------------------------------------------------------------ portfolios
_Q = """pq AS (SELECT *, greatest(1, ((rn - 1) * 5 + n - 2) // nullif(n - 1, 0))::INT AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY ret, ticker) AS rn, count(*) OVER (PARTITION BY week) AS n FROM weekly WHERE ret IS NOT NULL AND ret_next IS NOT NULL) WHERE n >= 25)"""
_LS = "ls AS (SELECT week, " + ", ".join(f"avg(ret_next) FILTER (WHERE bucket = {q}) AS q{q}" for q in range(1, 6)) + " FROM pq GROUP BY week)"


def _buckets(spark, d):
    return R.quantile_buckets(B.weekly(spark, d), "ret")


@query(B.sql("weekly", "SELECT ticker, week, bucket FROM pq", _Q))
def qcut_bins(spark, d):
    return _buckets(spark, d).select("ticker", "week", "bucket")


@query(B.sql("weekly", "SELECT week, " + ", ".join(f"round(q{q}, 6) AS q{q}" for q in range(1, 6)) + ", round(q5 - q1, 6) AS long_short FROM ls", _Q, _LS))
def quantile_portfolio_equal(spark, d):
    x = R.long_short(R.bucket_returns(_buckets(spark, d)))
    return x.select("week", *[r6(c).alias(c) for c in x.columns[1:]])


@query(B.sql("weekly", "SELECT week, bucket, round(sum(ret_next * value) / sum(value), 6) AS r, count(*) AS n FROM pq GROUP BY week, bucket", _Q))
def quantile_portfolio_value(spark, d):
    return R.bucket_returns(_buckets(spark, d), "value").withColumn("r", r6("r"))


_CHURN = """wk AS (SELECT week, lag(week) OVER (ORDER BY week) AS pw FROM (SELECT DISTINCT week FROM pq)), ch AS (SELECT week, avg(s) AS churn FROM (SELECT p.week, p.bucket, avg((o.ticker IS NULL)::INT) AS s FROM pq p JOIN wk USING (week)
    LEFT JOIN pq o ON o.week = wk.pw AND o.ticker = p.ticker AND o.bucket = p.bucket WHERE p.bucket IN (1, 5) GROUP BY p.week, p.bucket) GROUP BY week)"""


@query(B.sql("weekly", "SELECT week, round(churn, 6) AS churn FROM ch", _Q, _CHURN))
def portfolio_churn(spark, d):
    return R.churn(_buckets(spark, d)).select("week", r6("churn").alias("churn"))


@query(B.sql("weekly", "SELECT count(*) AS n, round(avg(q5 - q1), 6) AS gross, round(avg(q5 - q1 - 2 * 0.00871 * churn), 6) AS net, round(avg(q5 - q1 - 2 * 0.00871 * churn) / (stddev_samp(q5 - q1 - 2 * 0.00871 * churn) / sqrt(count(*))), 4) AS net_t FROM ls JOIN ch USING (week)", _Q, _LS, _CHURN))
def portfolio_net_of_cost(spark, d):
    b = _buckets(spark, d)
    x = R.net_of_cost(R.long_short(R.bucket_returns(b)), R.churn(b), R.round_trip_cost())
    return x.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("long_short")).alias("gross"), r6(F.avg("net")).alias("net"), F.round(F.avg("net") / (F.stddev_samp("net") / F.sqrt(F.count(F.lit(1)))), 4).alias("net_t"))


@query(B.sql("weekly", "SELECT week, v > m AS large, bucket, round(avg(ret_next), 6) AS r, count(*) AS n FROM (SELECT p.*, value AS v, median(value) OVER (PARTITION BY week) AS m FROM pq p) GROUP BY ALL", _Q))
def double_sort_portfolio(spark, d):
    b = _buckets(spark, d)
    m = b.groupBy("week").agg(F.percentile("value", 0.5).alias("m"))
    return b.join(m, "week").groupBy("week", (F.col("value") > F.col("m")).alias("large"), "bucket").agg(r6(F.avg("ret_next")).alias("r"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ event paths
_AR = "ars AS (SELECT *, ret - avg(ret) OVER (PARTITION BY week) AS ar, is_initiation OR (volume % 7 = 0) AS event FROM joined WHERE ret IS NOT NULL)"
_WIN = "win AS (SELECT *, " + ", ".join((f"lag(ar, {-t}) OVER w" if t < 0 else f"lead(ar, {t}) OVER w" if t else "ar") + f" AS p{t + 4}" for t in range(-4, 9)) + ", lag(week, 4) OVER w = week - 28 AND lead(week, 8) OVER w = week + 56 AS span FROM ars WINDOW w AS (PARTITION BY ticker ORDER BY week)), ok AS (SELECT * FROM win WHERE span)"


def _windows(spark, d):
    x = B.weekly(spark, d).where("ret IS NOT NULL").select("ticker", "week", "ret", "volume", "sparsity_tier", "is_initiation")
    x = R.abnormal_returns(x).withColumn("event", F.coalesce(F.col("is_initiation") | (F.col("volume") % 7 == 0), F.lit(False)))
    return R.event_windows(x)


@query(B.sql("weekly", "SELECT ticker, week, event, " + ", ".join(f"round(p{i}, 6) AS p{i}" for i in range(13)) + " FROM ok", _AR, _WIN))
def event_windows(spark, d):
    return _windows(spark, d).select("ticker", "week", "event", *[r6(F.col("path")[i]).alias(f"p{i}") for i in range(13)])


_TAU = "tau AS (" + " UNION ALL ".join(f"SELECT {i - 4} AS tau, p{i} AS ar FROM ok WHERE event" for i in range(13)) + "), st AS (SELECT tau, count(*) AS n, avg(ar) AS mean, stddev_samp(ar) / sqrt(count(*)) AS se FROM tau GROUP BY tau)"


@query(B.sql("weekly", "SELECT tau, n, round(mean, 6) AS mean, round(se, 6) AS se, round(mean / nullif(se, 0), 4) AS t, round(sum(mean) OVER (ORDER BY tau), 6) AS car FROM st", _AR, _WIN, _TAU))
def car_path(spark, d):
    return R.path_stats(_windows(spark, d).where("event")).select("tau", "n", r6("mean").alias("mean"), r6("se").alias("se"), F.round("t", 4).alias("t"), r6("car").alias("car"))


_MV = ("ar_m1", "ar_m2", "pre_car_34", "log_volume")
_CAND = "cand AS (SELECT ticker, week, sparsity_tier, event AS treated, p3 AS ar_m1, p2 AS ar_m2, p0 + p1 AS pre_car_34, p0 + p1 + p2 + p3 AS pre_car, ln(volume) AS log_volume, " + ", ".join(f"p{i}" for i in range(13)) + " FROM ok WHERE sparsity_tier IS NOT NULL)"
_ZC = "zc AS (SELECT *, " + ", ".join(f"coalesce(({v} - avg({v}) OVER g) / nullif(stddev_samp({v}) OVER g, 0), 0) AS z{i}" for i, v in enumerate(_MV)) + ", count(*) FILTER (WHERE treated) OVER g AS nt, count(*) FILTER (WHERE NOT treated) OVER g AS nc FROM cand WINDOW g AS (PARTITION BY week, sparsity_tier))"
_PAIR = """pr AS (SELECT * FROM (SELECT t.week, t.sparsity_tier, t.ticker AS t_ticker, c.ticker AS c_ticker, sqrt(""" + " + ".join(f"(t.z{i} - c.z{i}) * (t.z{i} - c.z{i})" for i in range(4)) + """) AS distance, """ + ", ".join(f"t.{v} AS t_{v}, c.{v} AS c_{v}" for v in _MV) + ", " + ", ".join(f"t.p{i} AS t{i}, c.p{i} AS c{i}" for i in range(13)) + """, t.pre_car AS t_pre_car,
    row_number() OVER (PARTITION BY t.week, t.sparsity_tier, t.ticker ORDER BY sqrt(""" + " + ".join(f"(t.z{i} - c.z{i}) * (t.z{i} - c.z{i})" for i in range(4)) + """), c.ticker) AS rank FROM zc t JOIN zc c ON t.week = c.week AND t.sparsity_tier = c.sparsity_tier AND t.treated AND NOT c.treated
    WHERE t.nc >= 2 AND """ + " AND ".join(f"abs(t.{v} - c.{v}) <= 0.5" for v in _MV[:3]) + ") WHERE rank <= 2)"


def _candidates(spark, d):
    w = _windows(spark, d).where("sparsity_tier IS NOT NULL").withColumn("log_volume", F.ln("volume"))
    return R.candidates(w, "event")


_NEAR = _PAIR.replace("pr AS (", "nr AS (", 1)
_NEAR = _NEAR[: _NEAR.index("WHERE t.nc >= 2")] + "WHERE t.nc >= 2) WHERE rank <= 2)"


@query(B.sql("weekly", "SELECT week, sparsity_tier, t_ticker, c_ticker, rank, round(distance, 6) AS distance FROM nr", _AR, _WIN, _CAND, _ZC, _NEAR))
def matched_pairs_nearest(spark, d):
    """The two nearest controls without a caliper."""
    x = R.match_pairs(_candidates(spark, d), k=2, caliper=None, variables=_MV)
    return x.select("week", "sparsity_tier", "t_ticker", "c_ticker", "rank", r6("distance").alias("distance"))


def _pairs(spark, d):
    return R.match_pairs(_candidates(spark, d), k=2, caliper=0.5, variables=_MV)


@query(B.sql("weekly", "SELECT week, sparsity_tier, t_ticker, c_ticker, rank, round(distance, 6) AS distance FROM pr", _AR, _WIN, _CAND, _ZC, _PAIR))
def matched_pairs_caliper(spark, d):
    return _pairs(spark, d).select("week", "sparsity_tier", "t_ticker", "c_ticker", "rank", r6("distance").alias("distance"))


@query(B.sql("weekly", " UNION ALL ".join(f"SELECT '{v}' AS variable, round(avg(t_{v}), 6) AS mean_t, round(avg(c_{v}), 6) AS mean_c, round((avg(t_{v}) - avg(c_{v})) / sqrt((var_samp(t_{v}) + var_samp(c_{v})) / 2), 6) AS smd, abs((avg(t_{v}) - avg(c_{v})) / sqrt((var_samp(t_{v}) + var_samp(c_{v})) / 2)) < 0.1 AS balanced FROM pr" for v in _MV), _AR, _WIN, _CAND, _ZC, _PAIR))
def balance_table(spark, d):
    x = R.balance(_pairs(spark, d), _MV)
    return x.select("variable", r6("mean_t").alias("mean_t"), r6("mean_c").alias("mean_c"), r6("smd").alias("smd"), "balanced")


def _did(pairs: str, name: str = "dp") -> list[str]:
    per = " UNION ALL ".join(f"SELECT {i - 4} AS tau, week, t_ticker, avg(t{i}) - avg(c{i}) AS dd FROM {pairs} GROUP BY week, t_ticker" for i in range(13))
    return [f"{name}_e AS ({per})", f"{name}_m AS (SELECT tau, avg(dd) AS m, count(*) AS n FROM {name}_e GROUP BY tau)", f"{name}_c AS (SELECT tau, week, sum(dd) AS s, count(*) AS k FROM {name}_e GROUP BY tau, week)",
        f"{name}_s AS (SELECT tau, any_value(m) AS diff, any_value(n) AS n_events, count(*) AS n_weeks, sum((s - k * m) * (s - k * m)) AS ss FROM {name}_c JOIN {name}_m USING (tau) GROUP BY tau)",
        f"{name} AS (SELECT *, CASE WHEN n_weeks > 1 THEN sqrt(n_weeks / (n_weeks - 1.0) * ss) / n_events END AS se FROM {name}_s)"]


_PATH = "SELECT tau, n_events, n_weeks, round(diff, 6) AS diff, round(se, 6) AS se, round(diff / nullif(se, 0), 4) AS t, round(sum(diff) OVER (ORDER BY tau), 6) AS car_diff FROM dp"


def _path(x):
    return x.select("tau", "n_events", "n_weeks", r6("diff").alias("diff"), r6("se").alias("se"), F.round("t", 4).alias("t"), r6("car_diff").alias("car_diff"))


@query(B.sql("weekly", _PATH, _AR, _WIN, _CAND, _ZC, _PAIR, *_did("pr")))
def did_path_clustered(spark, d):
    return _path(R.did_path(_pairs(spark, d)))


_CLEAN = "cl AS (SELECT * FROM pr, (SELECT quantile_cont(pre_car, 1.0::DOUBLE / 3) AS lo, quantile_cont(pre_car, 2.0::DOUBLE / 3) AS hi FROM cand WHERE treated) WHERE t_pre_car BETWEEN lo AND hi)"


@query(B.sql("weekly", _PATH, _AR, _WIN, _CAND, _ZC, _PAIR, _CLEAN, *_did("cl")))
def did_path_clean_subset(spark, d):
    return _path(R.did_path(R.clean_events(_candidates(spark, d), _pairs(spark, d))))


@query(B.sql("weekly", "SELECT tau, n_events, round(a, 6) AS treated_mean, round(b, 6) AS control_mean, round(a - b, 6) AS diff, round(sum(a - b) OVER (ORDER BY tau), 6) AS car_diff FROM (" + " UNION ALL ".join(f"SELECT {i - 4} AS tau, avg(p{i}) FILTER (WHERE treated) AS a, avg(p{i}) FILTER (WHERE NOT treated) AS b, count(*) FILTER (WHERE treated) AS n_events FROM cand" for i in range(13)) + ")", _AR, _WIN, _CAND))
def unmatched_path(spark, d):
    x = R.unmatched_path(_candidates(spark, d))
    return x.select("tau", "n_events", *[r6(c).alias(c) for c in ("treated_mean", "control_mean", "diff", "car_diff")])


@query(B.sql("weekly", """SELECT pre AS n_pre_significant, post AS n_post_significant, pre = 0 AS parallel, CASE WHEN n = 0 THEN 'no_matched_events' WHEN pre > 0 THEN 'not_identified' WHEN post > 0 THEN 'information' ELSE 'momentum_only' END AS verdict
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE tau < 0 AND NOT coalesce(abs(diff / nullif(se, 0)) < 1.96, false)) AS pre, count(*) FILTER (WHERE tau >= 1 AND coalesce(abs(diff / nullif(se, 0)) > 1.96, false)) AS post FROM dp)""", _AR, _WIN, _CAND, _ZC, _PAIR, *_did("pr")))
def matched_event_verdict(spark, d):
    return R.path_verdict(R.did_path(_pairs(spark, d)))


@query(B.sql("weekly", """SELECT bool_or(block = 'A' AND beta < 0 AND t < -1.96) AS any_negative, bool_or(block = 'B' AND h = 1 AND abs(t) > 1.96) AS effect, bool_or(block = 'B' AND h > 1 AND t < -1.96) AS reversal,
    CASE WHEN NOT bool_or(block = 'B' AND h = 1 AND abs(t) > 1.96) THEN 'no_main_effect' WHEN bool_or(block = 'A' AND beta < 0 AND t < -1.96) AND bool_or(block = 'B' AND h > 1 AND t < -1.96) THEN 'price_pressure' WHEN bool_or(block = 'A' AND beta < 0 AND t < -1.96) THEN 'information' ELSE 'not_concentrated' END AS verdict
    FROM (SELECT 'A' AS block, 0 AS h, avg(ret) AS beta, avg(ret) / (stddev_samp(ret) / sqrt(count(*))) AS t FROM weekly WHERE ret IS NOT NULL UNION ALL SELECT 'B', 1, avg(ret_next), avg(ret_next) / (stddev_samp(ret_next) / sqrt(count(*))) FROM weekly UNION ALL SELECT 'B', 2, avg(ret_lag1), avg(ret_lag1) / (stddev_samp(ret_lag1) / sqrt(count(*))) FROM weekly)"""))
def joint_reading_verdict(spark, d):
    x = B.weekly(spark, d)
    one = lambda b, h, c: R.mean_t(x.where(F.col(c).isNotNull()), c).select(F.lit(b).alias("block"), F.lit(h).alias("h"), F.col("mean").alias("beta"), "t")
    return R.joint_reading(one("A", 0, "ret").unionByName(one("B", 1, "ret_next")).unionByName(one("B", 2, "ret_lag1")))


# ------------------------------------------------------------------ estimators without a short SQL form
#: Both effects by 80 rounds of alternating means, then two regressors in closed form with two-way clusters.
_FE = ["z AS (SELECT ticker, week, sparsity_tier AS model, ret_next AS y, (att_all - avg(att_all) OVER t) / nullif(stddev_samp(att_all) OVER t, 0) AS a, (ret - avg(ret) OVER t) / nullif(stddev_samp(ret) OVER t, 0) AS b FROM weekly WHERE sparsity_tier IS NOT NULL WINDOW t AS (PARTITION BY sparsity_tier))",
    "d AS (SELECT * FROM z WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL)",
    "shape AS (SELECT m.model, count(d.y) AS n, count(DISTINCT ticker) AS e, count(DISTINCT week) AS t FROM (VALUES ('dense'), ('sparse'), ('silent')) m(model) LEFT JOIN d USING (model) GROUP BY ALL)",
    "go AS (SELECT model, n FROM shape WHERE n >= 100 AND e >= 5 AND t >= 20)",
    "it AS (SELECT 0 AS k, model, ticker, week, y, a, b FROM d SEMI JOIN go USING (model) UNION ALL SELECT k + 1, model, ticker, week, y - avg(y) OVER t, a - avg(a) OVER t, b - avg(b) OVER t FROM (SELECT k, model, ticker, week, y - avg(y) OVER i AS y, a - avg(a) OVER i AS a, b - avg(b) OVER i AS b FROM it WHERE k < 80 WINDOW i AS (PARTITION BY model, ticker)) WINDOW t AS (PARTITION BY model, week))",
    "m AS (SELECT * FROM it WHERE k = 80)",
    "g AS (SELECT model, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy, sum(y * y) AS yy FROM m GROUP BY model)",
    "c AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS ba, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS bc FROM g)",
    "sc AS (SELECT model, ticker, week, a * (y - ba * a - bc * b) AS sa, b * (y - ba * a - bc * b) AS sb FROM m JOIN c USING (model))",
    "cl AS (SELECT model, 1 AS sign, sum(sa) AS sa, sum(sb) AS sb FROM sc GROUP BY model, ticker UNION ALL SELECT model, 1, sum(sa), sum(sb) FROM sc GROUP BY model, week UNION ALL SELECT model, -1, sum(sa), sum(sb) FROM sc GROUP BY model, ticker, week)",
    "me AS (SELECT model, sum(sign * sa * sa) AS va, sum(sign * sa * sb) AS vab, sum(sign * sb * sb) AS vb FROM cl GROUP BY model)",
    "f AS (SELECT model, ba, bc, (ba * ay + bc * byy) / yy AS r2, sqrt(greatest((bb * bb * va - 2 * bb * ab * vab + ab * ab * vb) / (det * det) * n / (n - 2), 0)) AS sea, sqrt(greatest((ab * ab * va - 2 * aa * ab * vab + aa * aa * vb) / (det * det) * n / (n - 2), 0)) AS seb FROM c JOIN me USING (model) JOIN go USING (model))"]


@query(B.sql("weekly", "SELECT model, CASE WHEN ba IS NULL THEN 'SKIPPED' ELSE 'OK' END AS status, n AS n_obs, e AS n_entities, t AS n_periods, u.term, round(u.beta, 6) AS beta, round(u.se, 6) AS se, round(r2, 6) AS r2_within FROM shape LEFT JOIN f USING (model), LATERAL (SELECT 'z_att_all' AS term, ba AS beta, sea AS se WHERE ba IS NOT NULL UNION ALL SELECT 'z_ret', bc, seb WHERE ba IS NOT NULL UNION ALL SELECT NULL, NULL, NULL WHERE ba IS NULL) u", *_FE).replace("WITH ", "WITH RECURSIVE ", 1))
def two_way_fe_models(spark, d):
    """Fixed-effects regressions of next returns on attention, by tier, on unbalanced samples."""
    x = B.weekly(spark, d).select("ticker", "week", "ret_next", "ret", "sparsity_tier", F.col("att_all").cast("double").alias("att_all"))
    z = R.standardise(x, ["att_all", "ret"], ["sparsity_tier"])
    tiers = ("dense", "sparse", "silent")
    spec = F.array_position(F.array(*map(F.lit, tiers)), F.col("sparsity_tier")).cast("int")
    cols = ["ret_next", "z_att_all", "z_ret"]
    rows = z.dropna(subset=cols).select(spec.alias("spec"), F.col("ticker").alias("entity"), F.col("week").alias("time"), F.array(*cols).alias("c"))
    fits = absorb.fit_many(rows, {i: (t, cols[1:]) for i, t in enumerate(tiers, 1)}, (100, 5, 20))
    out = E.fits_table(spark, fits)
    return out.select("model", "status", "n_obs", "n_entities", "n_periods", "term", *[r6(c).alias(c) for c in ("beta", "se", "r2_within")])


#: Fifteen Newton steps of a three-parameter logistic regression; 3 x 3 systems by cofactors.
_ADJ3 = {"c00": "h11 * h22 - h12 * h12", "c01": "h02 * h12 - h01 * h22", "c02": "h01 * h12 - h02 * h11", "c11": "h00 * h22 - h02 * h02", "c12": "h02 * h01 - h00 * h12", "c22": "h00 * h11 - h01 * h01"}
_SUMS3 = "sum(y - p) AS g0, sum((y - p) * v) AS g1, sum((y - p) * r) AS g2, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * v) AS h01, sum(p * (1 - p) * r) AS h02, sum(p * (1 - p) * v * v) AS h11, sum(p * (1 - p) * v * r) AS h12, sum(p * (1 - p) * r * r) AS h22"
_LOGIT = ["lg AS (SELECT (att_all > 2)::INT::DOUBLE AS y, ln(1 + CASE WHEN count(volume) OVER f >= 2 THEN avg(volume) OVER f END) AS v, ret_lag1 AS r FROM weekly WINDOW f AS (PARTITION BY ticker ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))",
    "ld AS (SELECT * FROM lg WHERE v IS NOT NULL AND r IS NOT NULL)",
    f"nt AS (SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 UNION ALL SELECT k + 1, b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det, b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det FROM (SELECT *, h00 * c00 + h01 * c01 + h02 * c02 AS det FROM (SELECT *, {', '.join(f'{x} AS {c}' for c, x in _ADJ3.items())} FROM (SELECT k, b0, b1, b2, {_SUMS3} FROM (SELECT k, b0, b1, b2, y, v, r, 1 / (1 + exp(-(b0 + b1 * v + b2 * r))) AS p FROM nt, ld WHERE k < 15) GROUP BY k, b0, b1, b2))))",
    f"fi AS (SELECT *, h00 * c00 + h01 * c01 + h02 * c02 AS det FROM (SELECT *, {', '.join(f'{x} AS {c}' for c, x in _ADJ3.items())} FROM (SELECT b0, b1, b2, {_SUMS3}, sum(y * eta - greatest(eta, 0) - ln(1 + exp(-abs(eta)))) AS ll, count(*) AS n, avg(y) AS m FROM (SELECT *, b0 + b1 * v + b2 * r AS eta, 1 / (1 + exp(-(b0 + b1 * v + b2 * r))) AS p FROM nt, ld WHERE k = 15) GROUP BY b0, b1, b2)))",
    "te AS (SELECT u.term, u.beta, sqrt(u.c / det) AS se, 1 - ll / (n * (m * ln(m) + (1 - m) * ln(1 - m))) AS pseudo_r2, n FROM fi, LATERAL (VALUES ('const', b0, c00), ('lv', b1, c11), ('lr', b2, c22)) u(term, beta, c))"]


@query(B.sql("weekly", "SELECT term, round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 4) AS z, round(exp(beta), 6) AS odds_ratio, round(pseudo_r2, 6) AS pseudo_r2, n FROM te", *_LOGIT).replace("WITH ", "WITH RECURSIVE ", 1))
def propensity_logit(spark, d):
    x = B.weekly(spark, d).withColumns({"y": (F.col("att_all") > 2).cast("int"), "lv": F.log1p("vol_lag4"), "lr": F.col("ret_lag1")})
    f = E.logit(x, "y", ["lv", "lr"])
    rows = list(zip(f["term"], f["beta"], f["se"], f["z"], f["odds_ratio"]))
    out = spark.createDataFrame(rows, "term string, beta double, se double, z double, odds_ratio double")
    return out.select("term", r6("beta").alias("beta"), r6("se").alias("se"), F.round("z", 4).alias("z"), r6("odds_ratio").alias("odds_ratio"), r6(F.lit(float(f["pseudo_r2"]))).alias("pseudo_r2"), F.lit(f["n"]).alias("n"))


_WILD = ["wd AS (SELECT week::VARCHAR AS c, ret_next AS y, att_all::DOUBLE AS x, att_all * (att_weekend > 0)::INT::DOUBLE AS e FROM weekly WHERE ret_next IS NOT NULL)",
    "wg AS (SELECT count(*)::DOUBLE AS h00, sum(x) AS h01, sum(e) AS h02, sum(x * x) AS h11, sum(x * e) AS h12, sum(e * e) AS h22, sum(y) AS g0, sum(x * y) AS g1, sum(e * y) AS g2 FROM wd)",
    f"wi AS (SELECT *, c02 / det AS i0, c12 / det AS i1, c22 / det AS i2, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a0, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS a1, (c02 * g0 + c12 * g1 + c22 * g2) / det AS beta FROM (SELECT *, h00 * c00 + h01 * c01 + h02 * c02 AS det FROM (SELECT *, {', '.join(f'{x} AS {c}' for c, x in _ADJ3.items())} FROM wg)))",
    "wc AS (SELECT c, sum((i0 + i1 * x + i2 * e) * (a0 + a1 * x)) AS f, sum((i0 + i1 * x + i2 * e) * (y - a0 - a1 * x)) AS u FROM wd, wi GROUP BY c)",
    "wr AS (SELECT rep, sum(f) AS f, sum(CASE WHEN contains('02468ace', substr(md5('20260905|' || rep || '|' || c), 1, 1)) THEN u ELSE -u END) AS s, count(*) AS k FROM wc, range(1, 1000) r(rep) GROUP BY rep)"]


@query(B.sql("weekly", "SELECT round((SELECT beta FROM wi), 6) AS beta, round(avg((abs(f + s) >= abs((SELECT beta FROM wi)))::INT), 6) AS p, max(k) AS n_clusters, (SELECT h00::BIGINT FROM wg) AS n_obs, 999 AS n_boot FROM wr", *_WILD))
def wild_cluster_bootstrap(spark, d):
    x = B.weekly(spark, d).withColumns({"a": F.col("att_all").cast("double"), "inter": F.col("att_all") * (F.col("att_weekend") > 0).cast("double")})
    f = E.wild_cluster_bootstrap(x, "ret_next", "a", "inter")
    out = spark.createDataFrame([(f["beta"], f["p"], f["n_clusters"], f["n_obs"], f["n_boot"])], "beta double, p double, n_clusters long, n_obs long, n_boot long")
    return out.withColumns({"beta": r6("beta"), "p": r6("p")})


@query(B.sql("weekly", "SELECT sparsity_tier, sector, count(*) AS n, round(avg(ret), 6) AS mean_ret FROM weekly GROUP BY ROLLUP (sparsity_tier, sector)"))
def tier_sector_rollup(spark, d):
    """Subtotals over tier and sector."""
    return B.weekly(spark, d).rollup("sparsity_tier", "sector").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ret")).alias("mean_ret"))


_LAGS = range(1, 5)
_CO = ["r0 AS (SELECT ticker, week, ln(1 + att_all) AS y, ln(1 + volume::DOUBLE / 1e4 * 1e4) AS x1, abs(ret) AS x2, att_all FROM weekly WHERE volume IS NOT NULL AND ret IS NOT NULL)",
    "r1 AS (SELECT ticker, week, y - avg(y) OVER g AS y, x1 - avg(x1) OVER g AS x1, x2 - avg(x2) OVER g AS x2, count(*) OVER g AS n, stddev_samp(att_all) OVER g AS sd FROM r0 WINDOW g AS (PARTITION BY ticker))",
    "r2 AS (SELECT ticker, any_value(n) AS n, any_value(sd) AS sd, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c, sum(x1 * y) AS p, sum(x2 * y) AS q FROM r1 GROUP BY ticker)",
    "r3 AS (SELECT ticker, n, a, b, c, CASE WHEN n >= 30 AND sd > 0 AND a * c - b * b > 1e-12 * a * c THEN a * c - b * b END AS det, p, q FROM r2)",
    "r4 AS (SELECT *, (c * p - b * q) / det AS b1, (a * q - b * p) / det AS b2 FROM r3)",
    "r5 AS (SELECT ticker, week, x1 * (y - b1 * x1 - b2 * x2) AS s1, x2 * (y - b1 * x1 - b2 * x2) AS s2 FROM r1 JOIN r4 USING (ticker))",
    "r6 AS (SELECT *, " + ", ".join(f"lag({s}, {k}) OVER w AS {s}_{k}" for s in ("s1", "s2") for k in _LAGS) + " FROM r5 WINDOW w AS (PARTITION BY ticker ORDER BY week))",
    "r7 AS (SELECT ticker, " + ", ".join(f"sum({i} * {j}) + " + " + ".join(f"{1 - k / 5} * coalesce(sum({i} * {j}_{k} + {j} * {i}_{k}), 0)" for k in _LAGS) + f" AS {m}" for i, j, m in (("s1", "s1", "m11"), ("s1", "s2", "m12"), ("s2", "s2", "m22"))) + " FROM r6 GROUP BY ticker)",
    "r8 AS (SELECT ticker, n AS n_obs, b1, b1 / sqrt(greatest((c * c * m11 - 2 * c * b * m12 + b * b * m22) / (det * det), 1e-300)) AS t1, b2, b2 / sqrt(greatest((b * b * m11 - 2 * a * b * m12 + a * a * m22) / (det * det), 1e-300)) AS t2 FROM r4 JOIN r7 USING (ticker))"]


@query(B.sql("weekly", "SELECT ticker, n_obs, round(b1, 6) AS beta_turnover, round(t1, 4) AS t_turnover, round(b2, 6) AS beta_absret, round(t2, 4) AS t_absret, coalesce(t1 > 1.96 OR t2 > 1.96, false) AS passed FROM r8", *_CO))
def comovement_screen(spark, d):
    """Per-entity regressions of log attention on log turnover and absolute return."""
    from ..operators import specs

    x = specs.comovement(B.weekly(spark, d).withColumn("turnover", F.col("volume") / 1e4))
    return x.select("ticker", "n_obs", r6("beta_turnover").alias("beta_turnover"), F.round("t_turnover", 4).alias("t_turnover"), r6("beta_absret").alias("beta_absret"), F.round("t_absret", 4).alias("t_absret"), "passed")


_FM2 = ["fm AS (SELECT week, ret_next AS y, att_all::DOUBLE AS u, ret AS v FROM weekly WHERE ret_next IS NOT NULL AND ret IS NOT NULL)",
    "fs AS (SELECT week, covar_pop(u, u) AS a, covar_pop(u, v) AS b, covar_pop(v, v) AS c, covar_pop(u, y) AS p, covar_pop(v, y) AS q FROM fm GROUP BY week HAVING count(*) >= 20)",
    "fb AS (SELECT week, unnest(['att_all', 'ret']) AS term, unnest([(c * p - b * q) / (a * c - b * b), (a * q - b * p) / (a * c - b * b)]) AS b FROM fs)",
    "fe AS (SELECT *, b - avg(b) OVER (PARTITION BY term) AS e FROM fb)",
    "fl AS (SELECT term, " + ", ".join(f"coalesce(sum(e * e{k}), 0) AS s{k}" for k in range(5)) + ", count(*) AS n, avg(b) AS mean FROM (SELECT term, b, e, e AS e0, " + ", ".join(f"lag(e, {k}) OVER (PARTITION BY term ORDER BY week) AS e{k}" for k in range(1, 5)) + " FROM fe) GROUP BY term)"]


@query(B.sql("weekly", f"SELECT term, n, round(mean, 6) AS mean, round({_NWSE}, 6) AS se, round(mean / nullif({_NWSE}, 0), 4) AS t FROM fl WHERE n >= 10", *_FM2))
def fama_macbeth_two(spark, d):
    """Weekly cross-sections on attention and the week's return together."""
    x = B.weekly(spark, d).withColumn("att_all", F.col("att_all").cast("double"))
    return E.fama_macbeth(x, "ret_next", ["att_all", "ret"]).select("term", "n", r6("mean").alias("mean"), r6("se").alias("se"), F.round("t", 4).alias("t"))


_HORIZONS = (1, 2, 3)
_REV = B.twoway_sql("SELECT model, ticker, week, CASE model WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END AS y, x FROM (SELECT ticker, week, " + ", ".join(f"CASE WHEN lead(week, {h}) OVER w = week + {7 * h} THEN lead(ret, {h}) OVER w END AS r{h}" for h in _HORIZONS) + ", CASE WHEN sparsity_tier IS NOT NULL THEN (abn_att_all - avg(abn_att_all) OVER g) / nullif(stddev_samp(abn_att_all) OVER g, 0) END AS x FROM weekly WINDOW w AS (PARTITION BY ticker ORDER BY week), g AS (PARTITION BY sparsity_tier)), (VALUES (1), (2), (3)) v(model)")


@query(B.recursive(B.sql("weekly", f"SELECT 'reversal_all_h' || model AS model, n AS n_obs, round(beta, 6) AS beta, round({B.TWOWAY_SE}, 6) AS se FROM bb JOIN bv USING (model)", *_REV)))
def battery_reversal(spark, d):
    """The effect of abnormal attention one to three weeks on: three specifications in one battery."""
    from ..operators import panel as P
    from ..operators import specs

    x = P.lead_lag(B.weekly(spark, d), horizons=_HORIZONS)
    fits = specs.run(x, specs.reversal(x="abn_att_all", horizons=_HORIZONS[1:]), controls=(), gates=(50, 2, 5))
    return E.fits_table(spark, fits).select("model", "n_obs", r6("beta").alias("beta"), r6("se").alias("se"))


@query()
def comparison_items(spark, d):
    """The items that a published study reports, estimated on the analogue panel."""
    from ..operators import specs
    from .q_forecast import full_panel

    out = specs.comparison_items(full_panel(spark, d), controls=("ret_lag1", "log_market_cap"), gates=(100, 5, 20))
    return out.select("item", r6("ours").alias("ours"), r6("ours_se").alias("ours_se"))


@query()
def model_battery(spark, d):
    """Every battery over the full panel of the analogue, skipped specs included: one pass over all of them."""
    from ..operators import panel as P
    from ..operators import specs
    from .q_forecast import full_panel

    x = P.sector_peers(full_panel(spark, d), "abn_attention_weekend")
    battery = [*specs.main(), *specs.mechanism(), *specs.effort(), *specs.initiation(), *specs.reversal(horizons=range(2, 9)), *specs.spillover()]
    return specs.summary(spark, specs.run(x, battery, controls=("ret_lag1", "ret_lag4", "log_market_cap", "amihud"), gates=(100, 5, 20)))
