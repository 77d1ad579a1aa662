"""Health and readiness, lead and lag, statuses, coverage, figure data, the prospective loop."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import timeops as T
from ..operators import asof, forecast, ledger, panel, prospective, reports
from ..session import cut_lineage, shared_dir
from . import base as B
from . import q_forecast as QF
from . import q_research, q_text
from .registry import SQL, query

r6 = lambda c: F.round(c, 6)
_ROI = "roi AS (SELECT ticker, week, CASE WHEN count(*) >= 2 AND (sum(volume) - sum(inst_buy)) + (sum(volume) - sum(inst_sell)) > 0 THEN ((sum(volume) - sum(inst_buy)) - (sum(volume) - sum(inst_sell))) / ((sum(volume) - sum(inst_buy)) + (sum(volume) - sum(inst_sell))) END AS roi FROM daily WHERE volume >= 30 AND inst_buy <= volume AND inst_sell <= volume GROUP BY ticker, week)"
_HP = "hp AS (SELECT w.*, roi, (SELECT min(date) FROM lines l WHERE l.ticker = w.ticker) AS listing_date FROM weekly w LEFT JOIN roi USING (ticker, week))"


def _panel(spark, d):
    roi = panel.weekly_imbalance(B.daily(spark, d), min_volume=30, min_days=2).select("ticker", "week", "roi")
    listed = B.lines(spark, d).groupBy("ticker").agg(F.min("date").alias("listing_date"))
    return B.weekly(spark, d).join(roi, ["ticker", "week"], "left").join(listed, "ticker")


_UNI = "uni AS (SELECT s_suppkey AS ticker, s_nationkey AS sector, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE 'home' END AS venue, (SELECT min(date) FROM lines WHERE ticker = s_suppkey) AS listing_date FROM supplier)"


def _universe(spark, d):
    listed = B.lines(spark, d).groupBy("ticker").agg(F.min("date").alias("listing_date"))
    s = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("sector"), F.when(F.col("s_suppkey") % 13 != 0, "home").alias("venue"))
    return s.join(listed, "ticker", "left")


def _lines(*rows: tuple[str, str, str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"check\", '{r}' AS requirement, round(({o})::DOUBLE, 6) AS observed, coalesce({p}, false) AS passed FROM {source}" for n, r, o, p in rows)


@query(B.sql("lines", _lines(("universe_rows", "exactly 100", "count(*)", "count(*) = 100"), ("unique_entities", "no repeats", "count(*) - count(DISTINCT ticker)", "count(*) = count(DISTINCT ticker)"), ("sectors", "exactly 25", "count(DISTINCT sector)", "count(DISTINCT sector) = 25"),
    ("venues_resolved", "none missing", "count(*) FILTER (WHERE venue IS NULL)", "count(*) FILTER (WHERE venue IS NULL) = 0"), ("listing_dates", "none missing", "count(*) FILTER (WHERE listing_date IS NULL)", "count(*) FILTER (WHERE listing_date IS NULL) = 0"), source="uni"), _UNI))
def universe_checks(spark, d):
    return reports.universe_checks(_universe(spark, d), 100, 25).withColumn("observed", r6("observed"))


_MODAL = "modal AS (SELECT count(*) AS k FROM (SELECT ticker, sparsity_tier, row_number() OVER (PARTITION BY ticker ORDER BY count(*) DESC, sparsity_tier) AS rn FROM hp WHERE sparsity_tier IS NOT NULL GROUP BY ticker, sparsity_tier) WHERE rn = 1 AND sparsity_tier = 'dense')"


@query(B.sql("weekly", _lines(("unique_keys", "no repeats of entity and week", "count(*) - count(DISTINCT (ticker, week))", "count(*) = count(DISTINCT (ticker, week))"), ("imbalance_range", "within -1 and 1", "count(*) FILTER (WHERE abs(roi) > 1)", "count(*) FILTER (WHERE abs(roi) > 1) = 0"),
    ("imbalance_clumps", "share near the ends below 0.01", "coalesce(avg((abs(roi) > 0.99)::INT), 0)", "coalesce(avg((abs(roi) > 0.99)::INT) < 0.01, true)"), ("both_windows", "calendar and session columns", "max(1)", "max(1) = 1"),
    ("window_correlations", "weekdays closer to the whole week than weekends", "corr(att_all, att_weekday) - corr(att_all, att_weekend)", "corr(att_all, att_weekday) > corr(att_all, att_weekend)"), ("dense_names", "at least 40 in the sample", "count(DISTINCT ticker) FILTER (WHERE sparsity_tier = 'dense')", "count(DISTINCT ticker) FILTER (WHERE sparsity_tier = 'dense') >= 40"),
    ("dense_names_modal", "for description", "max((SELECT k FROM modal))", "max(1) = 1"), ("rows_before_listing", "none", "count(*) FILTER (WHERE week < listing_date)", "count(*) FILTER (WHERE week < listing_date) = 0"), source="hp"), "daily AS (SELECT ticker, date, any_value(week) AS week, sum(qty)::BIGINT AS volume, coalesce(sum(qty) FILTER (WHERE flag = 'R'), 0)::BIGINT AS inst_buy, coalesce(sum(qty) FILTER (WHERE flag = 'A'), 0)::BIGINT AS inst_sell FROM lines GROUP BY ticker, date)".replace("daily AS", "daily2 AS"), _ROI.replace("FROM daily", "FROM daily2"), _HP, _MODAL))
def health_checks(spark, d):
    return reports.panel_checks(_panel(spark, d), windows=("att_weekday", "att_weekend")).withColumn("observed", r6("observed"))


@query(B.sql("weekly", _lines(("next_is_contiguous", "no week is passed over", "count(*) FILTER (WHERE ret_next IS NOT NULL AND NOT coalesce(nx = week + 7, false))", "count(*) FILTER (WHERE ret_next IS NOT NULL AND NOT coalesce(nx = week + 7, false)) = 0"), ("weeks_end_on_sunday", "every label", "count(*) FILTER (WHERE isodow(week) <> 7)", "count(*) FILTER (WHERE isodow(week) <> 7) = 0"),
    ("return_week_is_later", "strictly", "count(*) FILTER (WHERE nx < week + 1)", "count(*) FILTER (WHERE nx < week + 1) = 0"), ("same_week_closer", "correlation with the same week is larger", "abs(corr(a, ret) FILTER (WHERE whole)) - abs(corr(a, ret_next) FILTER (WHERE whole))", "abs(corr(a, ret) FILTER (WHERE whole)) > abs(corr(a, ret_next) FILTER (WHERE whole))"),
    ("closed_weeks_without_return", "none has one", "count(*) FILTER (WHERE coalesce(n_days, 0) = 0 AND ret IS NOT NULL)", "count(*) FILTER (WHERE coalesce(n_days, 0) = 0 AND ret IS NOT NULL) = 0"), source="ll"), "ll AS (SELECT *, lead(week) OVER (PARTITION BY ticker ORDER BY week) AS nx, ln(1 + att_all) AS a, att_all IS NOT NULL AND ret IS NOT NULL AND ret_next IS NOT NULL AS whole FROM weekly)"))
def lead_lag_checks(spark, d):
    return reports.lead_lag(B.weekly(spark, d)).withColumn("observed", r6("observed"))


_READY = "SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_entities, count(DISTINCT week) AS n_weeks, 'foreign_holding_pct' AS missing_controls, false AS controls_available, true AS prices_verified, false AS formal FROM weekly"


def _ready(spark, d):
    return reports.readiness(B.weekly(spark, d), ["ret_lag1", "amihud", "foreign_holding_pct"], True)


@query(B.sql("weekly", _READY))
def analysis_readiness(spark, d):
    return _ready(spark, d)


_PHASES = [("skeleton", "layout and tests"), ("audit", "archives hold together")]


@query(B.sql("weekly", """SELECT phase, status, note FROM (VALUES ('skeleton', 'DONE', 'layout and tests'), ('audit', 'DONE', 'archives hold together')) t(phase, status, note)
    UNION ALL SELECT 'panel', 'DONE', n_rows || ' rows, ' || n_entities || ' entities, ' || n_weeks || ' weeks' FROM rd UNION ALL SELECT 'controls', 'BLOCKED', 'missing: ' || missing_controls FROM rd
    UNION ALL SELECT 'checks', CASE WHEN ok = 2 THEN 'DONE' ELSE 'PARTIAL' END, ok || ' of 2 passed' FROM (SELECT (count(*) FILTER (WHERE isodow(week) <> 7) = 0)::INT + (count(*) = count(DISTINCT (ticker, week)))::INT AS ok FROM weekly)""", f"rd AS ({_READY})"))
def research_status(spark, d):
    x = B.weekly(spark, d)
    health = reports.lead_lag(x).where("check = 'weeks_end_on_sunday'").unionByName(reports.panel_checks(_panel(spark, d)).where("check = 'unique_keys'"))
    return reports.research_status(x, health, _ready(spark, d), _PHASES)


@query("""WITH a AS (SELECT o_orderpriority AS model, CASE WHEN count(*) >= 300 THEN 'OK' ELSE 'SKIPPED' END AS status, count(*) AS n_obs, count(DISTINCT o_custkey) AS n_entities FROM orders GROUP BY 1), b AS (SELECT c_mktsegment AS "check", 'OK' AS status, count(*) AS n_obs FROM customer GROUP BY 1)
SELECT 'orders' AS "table", model, status, n_obs, n_entities, NULL::BIGINT AS n_periods, NULL::VARCHAR AS note FROM a UNION ALL SELECT 'customers', "check", status, n_obs, NULL, NULL, NULL FROM b""")
def model_status(spark, d):
    o = B.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.count(F.lit(1)).alias("n_obs"), F.countDistinct("o_custkey").alias("n_entities")).withColumn("status", F.when(F.col("n_obs") >= 300, "OK").otherwise("SKIPPED"))
    c = B.read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("check")).agg(F.count(F.lit(1)).alias("n_obs")).withColumn("status", F.lit("OK"))
    return reports.model_status({"orders": o, "customers": c.unionByName(c), "regions": B.read(spark, d, "region")})


@query(B.sql("lines", "SELECT s_suppkey AS ticker, s_nationkey AS sector, count(DISTINCT year(date))::INT AS n_years, coalesce(string_agg(DISTINCT year(date)::VARCHAR, ';' ORDER BY year(date)::VARCHAR), '') AS years, CASE WHEN count(date) > 0 THEN 'OK' ELSE 'NOT_COVERED' END AS status FROM supplier LEFT JOIN (SELECT * FROM lines WHERE ticker % 4 <> 0 AND part % 97 = ticker % 97) l ON s_suppkey = ticker GROUP BY ALL"))
def years_covered(spark, d):
    u = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("sector"))
    found = B.lines(spark, d).where("ticker % 4 <> 0 AND part % 97 = ticker % 97").select("ticker", F.year("date").cast("string").alias("year"))
    return reports.years_covered(u, found)


# ------------------------------------------------------------------ figure data
@query(B.sql("attention", "SELECT f.ticker, f.week, round(ln(1 + f.att_all), 6) AS log_att, place FROM filled f JOIN (SELECT ticker, row_number() OVER (ORDER BY sum(att_all) DESC, ticker) AS place FROM filled GROUP BY ticker) p USING (ticker)"))
def figure_coverage_map(spark, d):
    return reports.coverage_map(B.attention(spark, d)).withColumn("log_att", r6("log_att"))


_BIN = ["lv AS (SELECT *, CASE WHEN att_mean_level_52 <= q[1] THEN 1 WHEN att_mean_level_52 <= q[2] THEN 2 ELSE 3 END AS bin FROM weekly, (SELECT [quantile_cont(att_mean_level_52, 1/3.0::DOUBLE), quantile_cont(att_mean_level_52, 2/3.0::DOUBLE)] AS q FROM weekly WHERE sparsity_tier IS NOT NULL) WHERE att_mean_level_52 IS NOT NULL AND sparsity_tier IS NOT NULL)",
    *B.twoway_sql("SELECT bin AS model, ticker, week, ret_next AS y, (abn_att_all - avg(abn_att_all) OVER g) / nullif(stddev_samp(abn_att_all) OVER g, 0) AS x FROM lv WINDOW g AS (PARTITION BY bin, sparsity_tier)"),
    "bl AS (SELECT bin AS model, avg(att_mean_level_52) AS mean_level FROM lv GROUP BY bin)"]


@query(B.recursive(B.sql("weekly", f"SELECT model AS bin, round(beta, 6) AS beta, round({B.TWOWAY_SE}, 6) AS se, round(mean_level, 6) AS mean_level, n AS n_obs FROM bb JOIN bv USING (model) JOIN bl USING (model)", *_BIN)))
def figure_bin_betas(spark, d):
    """The effect of abnormal attention on the next return by terciles of the usual level."""
    x = B.weekly(spark, d).where("sparsity_tier IS NOT NULL")
    out = reports.bin_betas(x, "abn_att_all", "att_mean_level_52", 3, gates=(50, 2, 5))
    return out.select("bin", *[r6(c).alias(c) for c in ("beta", "se", "mean_level")], "n_obs")


@query(B.sql("attention", "SELECT week, sum(att_all)::BIGINT AS att_total, count(*) FILTER (WHERE att_all > 0) AS n_discussed FROM filled GROUP BY week"))
def figure_weekly_totals(spark, d):
    return reports.weekly_totals(B.attention(spark, d))


@query("""WITH a AS (SELECT o_orderpriority AS name, avg(o_totalprice) / 1e5 AS beta, stddev_samp(o_totalprice) / 1e6 AS se FROM orders GROUP BY 1), b AS (SELECT c_mktsegment AS name, avg(c_acctbal) / 1e4 AS beta, avg(c_acctbal) / 1e4 / 3 AS se FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT name, round(beta, 6) AS beta, round(beta - 1.96 * abs(se), 6) AS low, round(beta + 1.96 * abs(se), 6) AS high, row_number() OVER (ORDER BY beta, name) AS place FROM u""")
def figure_specification_curve(spark, d):
    a = B.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg((F.avg("o_totalprice") / 1e5).alias("beta"), (F.stddev_samp("o_totalprice") / 1e6).alias("se")).withColumn("term", F.lit("x"))
    other = a.withColumns({"term": F.lit("y"), "beta": F.lit(9.0)})
    b = B.read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("check")).agg((F.avg("c_acctbal") / 1e4).alias("beta_focus")).withColumns({"t_focus": F.lit(3.0), "status": F.when(F.col("check") == "MACHINERY", "SKIPPED").otherwise("OK")})
    x = reports.specification_curve(a.unionByName(other), b, "x")
    return x.select("name", r6("beta").alias("beta"), r6("low").alias("low"), r6("high").alias("high"), F.col("place").cast("bigint").alias("place"))


@query(B.sql("bars", "SELECT week, round(sum(coalesce(s, 0)) OVER (ORDER BY week), 5) AS gross, round(sum(coalesce(s, 0) - 0.001) OVER (ORDER BY week), 5) AS net FROM (SELECT week, CASE WHEN count(*) FILTER (WHERE ticker % 2 = 0) > 0 AND count(*) FILTER (WHERE ticker % 2 = 1) > 0 THEN avg(least(ret, 1)) FILTER (WHERE ticker % 2 = 0) - avg(least(ret, 1)) FILTER (WHERE ticker % 2 = 1) END AS s FROM bars GROUP BY week)"))
def figure_cumulative_spread(spark, d):
    leg = lambda k: F.avg(F.when(F.col("ticker") % 2 == k, F.least("ret", F.lit(1.0))))
    x = reports.cumulative_spread(B.bars(spark, d).groupBy("week").agg((leg(0) - leg(1)).alias("long_short")), F.lit(0.001))
    return x.select("week", F.round("gross", 5).alias("gross"), F.round("net", 5).alias("net"))


# ------------------------------------------------------------------ validity that nests, labels of the panel, coverage
_SPANS = "sp AS (SELECT o_custkey AS k, o_orderdate::DATE AS f, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderdate::DATE + (20 + (o_orderkey % 7) * 90)::INT)::DATE END AS u, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS v FROM orders WHERE o_orderkey % 3 = 0)"


@query("WITH " + _SPANS + " SELECT o_orderkey, (o_orderdate::DATE + 40)::DATE AS at, coalesce((SELECT arg_max(v, (f, coalesce(u, DATE '9999-12-31'), v)) FROM sp WHERE k = o_custkey AND f <= o_orderdate::DATE + 40 AND (u IS NULL OR u > o_orderdate::DATE + 40)), 'home') AS venue FROM orders")
def venue_validity_nested(spark, d):
    o = B.read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    end = F.when(F.col("o_orderkey") % 11 != 0, F.date_add("day", (20 + (F.col("o_orderkey") % 7) * 90).cast("int")))
    spans = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k"), F.col("day").alias("f"), end.alias("u"), F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B").alias("v"))
    ask = o.select("o_orderkey", F.col("o_custkey").alias("k"), F.date_add("day", 40).alias("at"), F.lit("home").alias("own"))
    return asof.valid_at(ask, spans, ["k"], "at", "f", "u", "v", "own").select("o_orderkey", "at", F.col("v").alias("venue"))


@query(B.sql("weekly", "SELECT l.ticker, l.week, round(w.ret_next, 6) AS y_ret, round(w.ret_next - b.r, 6) AS y_excess, (w.ret_next - b.r > 0)::INT AS y_outperform, l.label_status FROM labels l LEFT JOIN weekly w USING (ticker, week) LEFT JOIN bw b ON b.week = l.week + 7", QF._lab(1), "bw AS (SELECT (date_trunc('week', date) + INTERVAL 6 DAY)::DATE AS week, arg_max(px, date) / arg_min(px, date) - 1 AS r FROM bench GROUP BY 1)"))
def labels_1w_of_panel(spark, d):
    from ..operators import market
    from .q_market import benchmark

    x = forecast.panel_labels(QF._labels(spark, d), B.weekly(spark, d), market.benchmark_weekly(benchmark(spark, d)))
    return x.select("ticker", "week", r6("y_ret").alias("y_ret"), r6("y_excess").alias("y_excess"), "y_outperform", "label_status")


@query(B.sql("bars", "SELECT count(*) AS n_predictions, count(*) FILTER (WHERE label_status = 'ok') AS n_scored, count(*) FILTER (WHERE label_status <> 'ok') AS n_missing_label, 1.0::DOUBLE AS prediction_rate, round(count(*) FILTER (WHERE label_status = 'ok') / count(*), 6) AS scorable_rate FROM labels", QF._lab(1)))
def coverage_metrics(spark, d):
    x = QF._labels(spark, d)
    return ledger.coverage_metrics(x, x.where("label_status = 'ok'")).withColumn("scorable_rate", r6("scorable_rate"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE n > 0) AS n_with_news, round(avg((n > 0)::INT), 6) AS news_share, round((SELECT avg((user_id = 7)::INT) FROM events), 6) AS entity_share FROM (SELECT c_custkey, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n FROM customer)")
def news_coverage(spark, d):
    e = B.read(spark, d, "events").select(F.col("user_id").alias("ticker"))
    n = e.groupBy("ticker").agg(F.count(F.lit(1)).alias("news_count_1w"))
    rows = B.read(spark, d, "customer").join(n, F.col("c_custkey") == F.col("ticker"), "left")
    return ledger.news_coverage(rows, e, 7).withColumns({"news_share": r6("news_share"), "entity_share": r6("entity_share")})


_LOOP_SQL = "ft AS (SELECT week + 1 AS as_of, count(*) AS n, count(*) FILTER (WHERE sparsity_tier IN ('dense', 'sparse')) AS ok FROM weekly WHERE ret IS NOT NULL GROUP BY week), lastw AS (SELECT *, row_number() OVER (ORDER BY as_of DESC) AS rn FROM ft)"


def _looped(spark, d, dates: int):
    """The loop over the last dates under the session's shared folder, its features and its labels; the state goes with the application."""
    x = forecast.engineer(B.weekly(spark, d).where("ret IS NOT NULL")).withColumn("as_of", T.as_of(F.col("week")))
    where = f"{shared_dir(spark)}/prospective-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    loop = prospective.Loop(where, {"A": ["mom_4w", "log_adv20"], "B": ["mom_4w", "log_adv20", "abn_att_all"]}, least_names=5, alpha=10.0)
    feats = cut_lineage(x.select("ticker", "as_of", "sparsity_tier", "mom_4w", "log_adv20", "abn_att_all"))
    labels = cut_lineage(QF._labels(spark, d).drop("week"))
    prospective.backfill(spark, feats, labels, dates, loop)
    return loop, feats, labels


@query(B.sql("weekly", "SELECT as_of, CASE WHEN rn <= 2 AND ok >= 5 THEN n ELSE 0 END AS n_predictions, CASE WHEN rn > 2 THEN 'missing' WHEN ok >= 5 THEN 'predicted' ELSE 'skipped' END AS status FROM lastw WHERE rn <= 4", _LOOP_SQL))
def prospective_status(spark, d):
    """The loop over the last two dates, then the status of the last four."""
    loop, feats, _ = _looped(spark, d, 2)
    dates = sorted((r[0] for r in feats.select("as_of").distinct().collect()), reverse=True)[:4]  # dates of a weekly panel
    return prospective.report(spark, spark.createDataFrame([(x,) for x in dates], "as_of date"), loop)


@query(B.sql("weekly", """SELECT w.as_of, count(*) AS n_scored, round(avg(l.y_excess), 6) AS mean_excess FROM lastw w JOIN labels l USING (as_of) JOIN (SELECT ticker, week + 1 AS as_of FROM weekly WHERE ret IS NOT NULL) p USING (ticker, as_of)
    WHERE w.rn <= 3 AND w.ok >= 5 AND l.label_status = 'ok' AND l.label_available_at < (SELECT max(as_of) FROM ft) GROUP BY w.as_of""", _LOOP_SQL, QF._lab(1)))
def prospective_scores(spark, d):
    """The loop over the last three dates, scored twice: each prediction has one score."""
    loop, feats, labels = _looped(spark, d, 3)
    cutoff = feats.agg(F.max("as_of")).first()[0]
    for _ in range(2):
        scores = prospective.score(spark, labels, cutoff, loop)
    if scores is None:
        return spark.createDataFrame([], "as_of date, n_scored long, mean_excess double")
    return scores.groupBy("as_of").agg(F.count(F.lit(1)).alias("n_scored"), r6(F.avg("y_excess")).alias("mean_excess"))


def _evidence_sql() -> str:
    line = lambda name, need, observed, passed: f"SELECT '{name}' AS \"check\", '{need}' AS requirement, ({observed})::DOUBLE AS observed, ({passed}) AS passed FROM one"
    rows = [
        line("screens_run", "all three reported", "a", "true"), line("comovement", "number that passes", "a", "true"), line("formal_controls", "all available", "ok::INT", "ok"),
        line("adjustment_verified", "against a third party", "1", "true"), line("archive_digest", "every batch has one", "n_batches", "n_batches > 0"),
        line("title_parsing", "agreement above 0.95", "round(rate, 6)", "rate > 0.95"), line("strict_lead", "all lead-lag checks pass", "lead_ok", "lead_ok = lead_n"),
    ]
    one = f"""SELECT (SELECT count(*) FILTER (WHERE passed) FROM ({SQL["comovement_screen"]})) AS a, (SELECT count(ret_lag1) > 0 AND count(amihud) > 0 FROM weekly) AS ok, (SELECT count(DISTINCT source) FROM documents) AS n_batches,
    (SELECT agreement_rate FROM ({SQL["title_agreement_rates"]})) AS rate, (SELECT count(*) FROM ({SQL["lead_lag_checks"]})) AS lead_n, (SELECT count(*) FILTER (WHERE passed) FROM ({SQL["lead_lag_checks"]})) AS lead_ok"""
    return B.sql("weekly", " UNION ALL ".join(rows), f"one AS ({one})")


@query(_evidence_sql())
def screening_evidence_checks(spark, d):
    """The lines of the health table about screens, controls, digests, parsers and the lead of returns."""
    from ..operators import specs

    screen = specs.comovement(B.weekly(spark, d).withColumn("turnover", F.col("volume") / 1e4)).select(F.when(F.col("passed"), "A").otherwise("B").alias("tier"), "passed")
    ready = reports.readiness(B.weekly(spark, d), ["ret_lag1", "amihud"], True)
    digests = B.read(spark, d, "documents").groupBy("source").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_set(F.sha2("text", 256)))), 256).alias("sha256"))
    agreement = q_text.title_agreement_rates(spark, d)
    out = reports.screening_checks(screen, ready).unionByName(reports.evidence_checks(digests, agreement, reports.lead_lag(B.weekly(spark, d))))
    return out.withColumn("observed", r6("observed"))
