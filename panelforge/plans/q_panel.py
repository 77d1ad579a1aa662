"""Weeks, sessions, attention grids, look-backs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeops as T
from ..functions import windows as W
from ..operators import asof, market, panel, research
from . import base as B
from .registry import query

_ROUND = "round({}, 6)"
r6 = lambda c: F.round(c, 6)


@query(B.sql("lines", "SELECT date, week, week + 7 AS return_week, week + 1 AS as_of, week AS back, (week + 1 - 1)::DATE AS latest, count(*) AS n FROM lines GROUP BY date, week"))
def week_label(spark, d):
    x = B.lines(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n")).withColumn("week", T.week_of(F.col("date")))
    at = T.as_of(F.col("week"))
    return x.select("date", "week", T.return_week(F.col("week")).alias("return_week"), at.alias("as_of"), T.feature_week(at).alias("back"), T.latest_feature_week(at).alias("latest"), "n")


@query(B.sql("attention", "SELECT ticker, week, att_all, round(abn_att_all, 6) AS abn_att_all, att_nonzero_weeks_52, sparsity_tier FROM attention"))
def abnormal_attention_weekly(spark, d):
    return B.attention(spark, d).select("ticker", "week", "att_all", r6("abn_att_all").alias("abn_att_all"), "att_nonzero_weeks_52", "sparsity_tier")


@query(B.sql("attention", """SELECT ticker, week, round(CASE WHEN att_all > 0 THEN ln(att_all) END - CASE WHEN count(CASE WHEN att_all > 0 THEN 1 END) OVER w >= 8
    THEN avg(CASE WHEN att_all > 0 THEN ln(att_all) END) OVER w END, 6) AS abn FROM filled WINDOW w AS (PARTITION BY ticker ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"""))
def abnormal_positive_only(spark, d):
    w = W.by("ticker", "week")
    return B.attention(spark, d).select("ticker", "week", r6(W.abnormal(F.col("att_all"), w, positive_only=True)).alias("abn"))


@query(B.sql("attention", "SELECT ticker, week, att_nonzero_weeks_52, round(att_mean_level_52, 6) AS att_mean_level_52 FROM attention"))
def sparsity_fields_52w(spark, d):
    return B.attention(spark, d).select("ticker", "week", "att_nonzero_weeks_52", r6("att_mean_level_52").alias("att_mean_level_52"))


@query(B.sql("attention", """SELECT a.sparsity_tier AS tier, count(*) AS n_rows, count(DISTINCT a.ticker) AS n_any_week, (SELECT count(*) FROM modes m WHERE m.rn = 1 AND m.sparsity_tier = a.sparsity_tier) AS n_modal FROM attention a WHERE a.sparsity_tier IS NOT NULL GROUP BY a.sparsity_tier""", """modes AS (SELECT ticker, sparsity_tier, row_number() OVER (PARTITION BY ticker ORDER BY count(*) DESC, sparsity_tier) AS rn FROM attention WHERE sparsity_tier IS NOT NULL GROUP BY ticker, sparsity_tier)"""))
def sparsity_tier_distribution(spark, d):
    a = B.attention(spark, d).select("ticker", "sparsity_tier")
    modal = research.mode_per_group(a, "ticker", "sparsity_tier").groupBy(F.col("mode").alias("tier")).agg(F.count(F.lit(1)).alias("n_modal"))
    rows = a.where("sparsity_tier IS NOT NULL").groupBy(F.col("sparsity_tier").alias("tier")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ticker").alias("n_any_week"))
    return rows.join(modal, "tier", "left").select("tier", "n_rows", "n_any_week", F.coalesce("n_modal", F.lit(0)).alias("n_modal"))


@query(B.sql("attention", "SELECT ticker, week, att_all, is_initiation, zero_base::INT AS att_zero_base FROM attention"))
def initiation_events(spark, d):
    return B.attention(spark, d).select("ticker", "week", "att_all", "is_initiation", "att_zero_base")


@query(B.sql("attention", "SELECT sparsity_tier, count(*) FILTER (WHERE is_initiation) AS n_events, count(DISTINCT ticker) FILTER (WHERE is_initiation) AS n_entities, count(DISTINCT week) FILTER (WHERE is_initiation) AS n_weeks FROM attention GROUP BY sparsity_tier"))
def initiation_feasibility(spark, d):
    return research.initiation_counts(B.attention(spark, d))


@query(B.sql("counted", "SELECT * FROM counted"))
def attention_windows_matrix(spark, d):
    return B.counted(spark, d)


_LISTED = "listed AS (SELECT ticker, min(date) AS listing_date FROM lines GROUP BY ticker)"


@query(B.sql("attention", """SELECT p.ticker, p.week, coalesce(c.att_all, 0) AS att_all, round(datediff('day', listing_date, p.week) / 365.25, 6) AS age FROM pit p LEFT JOIN counted c USING (ticker, week)""", _LISTED, """pit AS (SELECT l.ticker, unnest(generate_series((date_trunc('week', listing_date) + INTERVAL 6 DAY)::DATE, (SELECT max(week) FROM lines), INTERVAL 7 DAY))::DATE AS week, listing_date FROM listed l)"""))
def post_listing_grid(spark, d):
    _, b = B.span(spark, d)
    listed = B.lines(spark, d).groupBy("ticker").agg(F.min("date").alias("listing_date"))
    cells = panel.grid(listed, "ticker", T.week_of(F.col("listing_date")), F.lit(b))
    full = panel.fill_counts(cells, B.counted(spark, d).select("ticker", "week", "att_all"), ["ticker", "week"])
    return full.join(listed, "ticker").select("ticker", "week", "att_all", r6(T.age_years(F.col("listing_date"), F.col("week"))).alias("age"))


_PIT = _LISTED + """,
pit AS (SELECT l.ticker, unnest(generate_series((date_trunc('week', listing_date) + INTERVAL 6 DAY)::DATE, (SELECT max(week) FROM lines), INTERVAL 7 DAY))::DATE AS week FROM listed l),
pf AS (SELECT p.ticker, p.week, coalesce(c.att_all, 0) AS att_all FROM pit p LEFT JOIN counted c USING (ticker, week)),
pw AS (SELECT *, ln(1 + att_all) - CASE WHEN count(*) OVER w8 >= 8 THEN avg(ln(1 + att_all)) OVER w8 END AS abn FROM pf WINDOW w8 AS (PARTITION BY ticker ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"""


@query(B.sql("attention", "SELECT a.ticker, a.week, round(a.abn_att_all, 6) AS research, round(p.abn, 6) AS point_in_time FROM attention a JOIN listed l USING (ticker) LEFT JOIN pw p ON p.ticker = a.ticker AND p.week = a.week WHERE a.week >= (date_trunc('week', listing_date) + INTERVAL 6 DAY)::DATE", _PIT))
def pit_vs_research_diff(spark, d):
    a, b = B.span(spark, d)
    listed = B.lines(spark, d).groupBy("ticker").agg(F.min("date").alias("listing_date"))
    counts, none = B.counted(spark, d).select("ticker", "week", "att_all"), B.bars(spark, d).select("ticker", "week", "ret")
    cells = panel.grid(listed, "ticker", F.lit(a), F.lit(b))
    research_ = panel.research_panel(cells, counts, none, listed).select("ticker", "week", r6("abn_att_all").alias("research"))
    pit = panel.point_in_time_panel(listed, counts, none, F.lit(b)).select("ticker", "week", r6("abn_att_all").alias("point_in_time"))
    return research_.join(pit, ["ticker", "week"], "left")


# ------------------------------------------------------------------ sessions on the event stream
_CAL = """ev AS (SELECT ts, ts::DATE AS date, user_id, event_type, value FROM events),
cal AS (SELECT date FROM ev GROUP BY date HAVING count(*) >= 20 AND isodow(date) < 6)"""


def _calendar(spark, d):
    e = B.read(spark, d, "events").withColumn("date", F.col("ts").cast("date"))
    return e, e.groupBy("date").count().where((F.col("count") >= 20) & ~T.is_weekend(F.col("date"))).select("date")


@query("WITH " + _CAL + """ SELECT event_type, CASE WHEN isodow(ev.date) >= 6 THEN 'weekend' ELSE 'weekday' END AS cal_window,
CASE WHEN cal.date IS NOT NULL AND hour(ts) * 60 + minute(ts) >= 540 AND hour(ts) * 60 + minute(ts) < 810 THEN 'intraday' ELSE 'non_trading' END AS session, count(*) AS n FROM ev LEFT JOIN cal USING (date) GROUP BY ALL""")
def session_window_counts(spark, d):
    e, cal = _calendar(spark, d)
    x = e.join(F.broadcast(cal.withColumn("open", F.lit(True))), "date", "left")
    return x.groupBy("event_type", T.calendar_window(F.col("date")).alias("cal_window"), T.session_window(F.col("ts"), F.col("open")).alias("session")).agg(F.count(F.lit(1)).alias("n"))


_NEXT = _CAL + """, nxt AS (SELECT ev.*, CASE WHEN hour(ts) * 60 + minute(ts) < 810 AND ev.date IN (SELECT date FROM cal) THEN ev.date ELSE (SELECT min(date) FROM cal WHERE cal.date > ev.date) END AS next_day FROM ev)"""


@query("WITH " + _NEXT + " SELECT date, next_day, CASE WHEN next_day IS NOT NULL THEN (date_trunc('week', date) + INTERVAL 6 DAY)::DATE END AS att_week, count(*) AS n FROM nxt GROUP BY ALL")
def next_trading_day(spark, d):
    x = _next(spark, d)
    return x.groupBy("date", "next_day", F.when(F.col("next_day").isNotNull(), T.week_of(F.col("date"))).alias("att_week")).agg(F.count(F.lit(1)).alias("n"))


def _next(spark, d):
    e, cal = _calendar(spark, d)
    return asof.next_sessions(e, cal, "date", T.minute_of_day(F.col("ts")), T.CLOSE_MINUTE)


@query("WITH " + _NEXT + " SELECT event_type, count(*) AS n_excluded, max(ts) AS last_ts FROM nxt WHERE next_day IS NULL GROUP BY event_type")
def excluded_no_next_day(spark, d):
    return _next(spark, d).where("next_day IS NULL").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_excluded"), F.max("ts").alias("last_ts"))


@query(B.sql("daily", "SELECT date, isodow(date) - 1 AS weekday, isodow(date) = 6 AS is_makeup_saturday, count(DISTINCT ticker) AS n_traded FROM daily GROUP BY date HAVING count(DISTINCT ticker) >= 5"))
def trading_calendar(spark, d):
    return market.trading_calendar(B.daily(spark, d), 5)


@query(B.sql("daily", "SELECT week, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_days FROM daily GROUP BY week"))
def calendar_week_bounds(spark, d):
    return asof.calendar_bounds(B.daily(spark, d))


@query(B.sql("daily", """SELECT ticker, week, a, b, (SELECT count(*) FROM cal WHERE date BETWEEN a AND b) AS n_sessions FROM spans""", """spans AS (SELECT DISTINCT ticker, week, min(date) AS a, max(date) AS b FROM daily GROUP BY ticker, week), cal AS (SELECT DISTINCT date FROM daily WHERE isodow(date) < 6)"""))
def trading_session_count(spark, d):
    x = B.daily(spark, d)
    spans = x.groupBy("ticker", T.week_of(F.col("date")).alias("week")).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return asof.session_count(spans, x.where(~T.is_weekend(F.col("date"))).select("date"), "a", "b").select("ticker", "week", "a", "b", "n_sessions")


@query(B.sql("counted", "SELECT ticker, week, att_all, week >= DATE '1997-06-01' AS regime_a, week >= DATE '1999-03-23' AS regime_b, week >= DATE '2000-10-26' AS regime_c FROM counted"))
def regime_flags(spark, d):
    return panel.regime_flags(B.counted(spark, d).select("ticker", "week", "att_all"), {"regime_a": "1997-06-01", "regime_b": "1999-03-23", "regime_c": "2000-10-26"})


@query(B.sql("lines", "SELECT ticker, min(date) AS listing_date, round(datediff('day', min(date), DATE '2002-01-01') / 365.25, 6) AS age FROM lines GROUP BY ticker"))
def listing_age(spark, d):
    x = B.lines(spark, d).groupBy("ticker").agg(F.min("date").alias("listing_date"))
    return x.withColumn("age", r6(T.age_years(F.col("listing_date"), F.lit("2002-01-01").cast("date"))))


@query(B.sql("lines", "SELECT article, ticker, n AS n_entities, n > 6 AS is_bulk FROM (SELECT DISTINCT article, ticker FROM lines) JOIN (SELECT article, count(DISTINCT ticker) AS n FROM lines GROUP BY article) USING (article)"))
def bulk_listing_flag(spark, d):
    return panel.bulk_flag(B.lines(spark, d).select("article", "ticker").distinct(), "article", "ticker", 6)


@query(B.sql("lines", "SELECT k AS threshold, count(*) FILTER (WHERE n <= k) AS n_kept, round(avg((n <= k)::INT), 6) AS share FROM (SELECT DISTINCT article, ticker FROM lines) JOIN (SELECT article, count(DISTINCT ticker) AS n FROM lines GROUP BY article) USING (article), (VALUES (2), (4), (6), (8), (999)) t(k) GROUP BY k"))
def bulk_threshold_grid(spark, d):
    x = panel.bulk_flag(B.lines(spark, d).select("article", "ticker").distinct(), "article", "ticker", 999)
    grid = [2, 4, 6, 8, 999]
    one = x.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("n_entities") <= k).alias(f"k{k}") for k in grid])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("threshold"), F.col(f"k{k}").alias("n_kept")) for k in grid]))
    return one.select("n", rows.alias("r")).select("r.threshold", "r.n_kept", r6(F.col("r.n_kept") / F.col("n")).alias("share"))


@query(B.sql("lines", "SELECT k AS threshold, ticker, week, count(*) AS att_all FROM (SELECT DISTINCT article, ticker, week FROM lines) JOIN (SELECT article, count(DISTINCT ticker) AS n FROM lines GROUP BY article) USING (article), (VALUES (2), (4), (6), (999)) t(k) WHERE n <= k GROUP BY ALL"))
def bulk_threshold_attention(spark, d):
    """Weekly attention under every threshold of entities an article."""
    x = B.lines(spark, d).select("article", "ticker", T.week_of(F.col("date")).alias("week")).repartition("article").distinct()
    return panel.bulk_sensitivity(x, "article", [2, 4, 6, 999])


@query(B.sql("lines", "SELECT m::DATE AS month FROM (SELECT unnest(generate_series((SELECT min(m) FROM f)::TIMESTAMP, (SELECT max(m) FROM f)::TIMESTAMP, INTERVAL 1 MONTH)) AS m) WHERE m::DATE NOT IN (SELECT m FROM f)", "f AS (SELECT DISTINCT date_trunc('month', date)::DATE AS m FROM lines WHERE month(date) % 5 <> 0 AND ticker % 3 = 0)"))
def month_gaps(spark, d):
    return research.month_gaps(B.lines(spark, d).where("month(date) % 5 <> 0 AND ticker % 3 = 0"), F.col("date"))


@query(B.sql("attention", "SELECT ticker, week, att_all, att_all - lag(att_all) OVER w AS delta, round(att_all - CASE WHEN count(*) OVER w4 >= 2 THEN avg(att_all) OVER w4 END, 6) AS trend FROM filled WINDOW w AS (PARTITION BY ticker ORDER BY week), w4 AS (PARTITION BY ticker ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"))
def attention_delta_trend(spark, d):
    w, x = W.by("ticker", "week"), F.col("att_all")
    return B.attention(spark, d).select("ticker", "week", "att_all", (x - F.lag(x).over(w)).alias("delta"), r6(x - W.trailing(x, 4, 2, w)).alias("trend"))


@query(B.sql("weekly", """SELECT ticker, week, sector, att_all, (sum(att_all) OVER g)::BIGINT AS sector_total, count(att_all) OVER g AS sector_n,
    round((sum(att_all) OVER g - att_all) / nullif(count(att_all) OVER g - 1, 0), 6) AS peer_mean, round(att_all - avg(att_all) OVER g, 6) AS relative_to_sector FROM joined WINDOW g AS (PARTITION BY sector, week)"""))
def sector_peer_attention(spark, d):
    x = panel.sector_peers(B.weekly(spark, d))
    return x.select("ticker", "week", "sector", "att_all", "sector_total", "sector_n", r6("peer_mean").alias("peer_mean"), r6("relative_to_sector").alias("relative_to_sector"))
