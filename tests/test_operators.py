"""As-of joins, panels, market, evaluation, ledger, trading, matching, estimators."""

import datetime as dt
import json
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import arrays
from panelforge.functions import timeops as T
from panelforge.functions import windows as W
from panelforge.functions.quantiles import exact_percentiles
from panelforge.operators import asof, backtest, estimators, evaluate, forecast, ledger, market, matcher, models, panel, prospective, research

D = dt.date.fromisoformat


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ------------------------------------------------------------------ joins
def test_asof_strictness(spark):
    left = spark.createDataFrame([("a", D("2024-05-06")), ("a", D("2024-04-01")), ("b", D("2024-05-06"))], "k string, t date")
    right = spark.createDataFrame([("a", D("2024-05-06"), 2.0), ("a", D("2024-04-10"), 1.0)], "k string, e date, v double")
    assert rows(asof.backward(left, right, ["k"], "t", "e", ["v"]).na.fill(-1), "k", "t", "v") == [("a", D("2024-04-01"), -1.0), ("a", D("2024-05-06"), 1.0), ("b", D("2024-05-06"), -1.0)]
    assert rows(asof.backward(left, right, ["k"], "t", "e", ["v"], strict=False).where("k = 'a'").na.fill(-1), "t", "v") == [(D("2024-04-01"), -1.0), (D("2024-05-06"), 2.0)]
    assert rows(asof.forward(left, right, ["k"], "t", "e", ["v"]).where("k = 'a'").na.fill(-1), "t", "v") == [(D("2024-04-01"), 1.0), (D("2024-05-06"), -1.0)]
    assert rows(asof.forward(left, right, ["k"], "t", "e", ["v"], strict=False).where("k = 'a'").na.fill(-1), "t", "v") == [(D("2024-04-01"), 1.0), (D("2024-05-06"), 2.0)]


def test_calendar(spark):
    days = spark.createDataFrame([(D(f"2024-05-{x:02d}"),) for x in (6, 7, 8, 9, 10, 13)], "date date")
    assert rows(asof.calendar_bounds(days), "week", "first_date", "last_date", "n_days") == [(D("2024-05-12"), D("2024-05-06"), D("2024-05-10"), 5), (D("2024-05-19"), D("2024-05-13"), D("2024-05-13"), 1)]
    nxt = dict(rows(asof.dense_calendar(days), "d", "next_day")[:-1])
    assert nxt[D("2024-05-10")] == D("2024-05-13") and nxt[D("2024-05-11")] == D("2024-05-13")
    r = spark.createDataFrame([(D("2024-05-06"), D("2024-05-10")), (D("2024-05-11"), D("2024-05-12"))], "a date, b date")
    assert rows(asof.session_count(r, days, "a", "b"), "n_sessions") == [(0,), (5,)]
    wide = spark.createDataFrame([(D("2024-01-01"), D("2024-12-31")), (D("2024-01-01"), D("2024-05-07")), (D("2024-06-01"), D("2024-06-02")), (D("2023-01-01"), D("2023-06-02"))], "a date, b date")
    assert rows(asof.session_count(wide, days, "a", "b"), "a", "n_sessions") == [(D("2023-01-01"), 0), (D("2024-01-01"), 2), (D("2024-01-01"), 6), (D("2024-06-01"), 0)]


def test_frames_read_backwards_stay_linear(spark):
    n = 100_000
    left = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    right = spark.range(0, n, 7).select(F.lit("a").alias("k"), F.col("id").alias("e"), F.col("id").alias("v"))
    start = time.monotonic()
    out = asof.forward(left, right, ["k"], "t", "e", ["v"], strict=False).where("v IS NOT NULL").agg(F.min(F.col("v") - F.col("t")), F.max(F.col("v") - F.col("t"))).first()
    assert tuple(out) == (0, 6)
    d = left.select("k", "t", F.when(F.col("t") % 10 == 9, F.col("t")).alias("x"))
    assert d.select("t", W.bfill(F.col("x"), "k", "t").alias("y")).where("y - t > 9 OR y < t").count() == 0
    assert time.monotonic() - start < 60


def test_validity(spark):
    left = spark.createDataFrame([("a", D(x)) for x in ("2020-01-01", "2021-06-01", "2023-01-01")], "k string, t date").withColumn("own", F.lit("home"))
    spans = spark.createDataFrame([("a", D("2021-01-01"), D("2022-01-01"), "X")], "k string, f date, u date, v string")
    assert rows(asof.valid_at(left, spans, ["k"], "t", "f", "u", "v", "own"), "t", "v") == [(D("2020-01-01"), "home"), (D("2021-06-01"), "X"), (D("2023-01-01"), "home")]
    nested = spark.createDataFrame([("a", D("2019-01-01"), None, "outer"), ("a", D("2021-01-01"), D("2022-01-01"), "inner"), ("a", D("2022-06-01"), D("2022-06-01"), "empty")], "k string, f date, u date, v string")
    assert rows(asof.valid_at(left, nested, ["k"], "t", "f", "u", "v", "own"), "t", "v") == [(D("2020-01-01"), "outer"), (D("2021-06-01"), "inner"), (D("2023-01-01"), "outer")]


def test_spans_of_one_start(spark):
    """Equal starts: the greatest end, then the greatest value, in whatever order the rows come."""
    left = spark.createDataFrame([(k, D(x)) for k in "abc" for x in ("2020-02-01", "2023-01-01")], "k string, t date").withColumn("own", F.lit("home"))
    day, end = D("2020-01-01"), D("2021-01-01")
    spans = [("a", day, end, "B"), ("a", day, end, "A"), ("b", day, None, "A"), ("b", day, None, "B"), ("b", day, end, "C"), ("c", day, end, "A"), ("c", day, None, "A"), ("c", day, end, "B")]
    for order in (spans, spans[::-1]):
        got = asof.valid_at(left, spark.createDataFrame(order, "k string, f date, u date, v string").coalesce(1), ["k"], "t", "f", "u", "v", "own")
        assert rows(got, "k", "t", "v") == [("a", D("2020-02-01"), "B"), ("a", D("2023-01-01"), "home"), ("b", D("2020-02-01"), "B"), ("b", D("2023-01-01"), "B"), ("c", D("2020-02-01"), "A"), ("c", D("2023-01-01"), "A")]


# ------------------------------------------------------------------ market and panel
def test_adjustment(spark):
    daily = spark.createDataFrame([("a", D(f"2022-09-{x}"), p) for x, p in ((15, 81.0), (16, 80.0), (19, 169.0), (20, 172.5))], "ticker string, date date, close double").withColumn("open", F.col("close"))
    ev = spark.createDataFrame([("a", D("2022-09-19"), "reduction", 80.0, 167.2), ("a", D("2022-09-20"), "exright", 100.0, 20.0)], "ticker string, date date, kind string, before_price double, after_price double")
    fac = market.factors(ev)
    assert [(r.date, round(r.factor, 2)) for r in fac.collect()] == [(D("2022-09-19"), 2.09)]
    adj = market.daily_returns(market.adjust(daily, fac).withColumn("value", F.lit(1e9)))
    assert all(abs(r.daily_ret) <= 0.1 for r in adj.where("daily_ret IS NOT NULL").collect())


def test_imbalance(spark):
    d = spark.createDataFrame([(1000, 300, 100), (1000, 200, 200), (0, 0, 0)], "v long, b long, s long")
    assert [r.o for r in d.select(panel.imbalance(F.col("v"), F.col("b"), F.col("s")).alias("o")).collect()] == [-0.125, 0.0, None]
    days = [("a", D("2024-05-06") + dt.timedelta(i), 20_000, 100, 50 if i else 30_000) for i in range(5)] + [("b", D("2024-05-06") + dt.timedelta(i), 20_000, 1, 1) for i in range(2)]
    w = spark.createDataFrame(days, "ticker string, date date, volume long, inst_buy long, inst_sell long")
    assert [(r.ticker, r.n_valid_days, r.roi is None) for r in panel.weekly_imbalance(w).orderBy("ticker").collect()] == [("a", 4, False), ("b", 2, True)]


def test_fill_without_backfill(spark):
    d = spark.createDataFrame([("a", D(f"2024-05-{x:02d}")) for x in (6, 7, 8)], "ticker string, date date")
    s = spark.createDataFrame([("a", D("2024-05-08"), 1000)], "ticker string, date date, n long")
    assert rows(market.fill_samples(d, s, ["n"]).na.fill(-1), "n") == [(-1,), (-1,), (1000,)]
    assert rows(market.fill_samples(d, s, ["n"], back=True), "n") == [(1000,)] * 3


def test_reconcile(spark):
    d = spark.createDataFrame([(10, 4, 6), (10, 4, 9)], "b long, s long, n long")
    assert market.reconcile(d, "b", "s", "n").first().ok is False
    with pytest.raises(ValueError):
        market.check_reconciled(d, bought="b", sold="s", net="n")


# ------------------------------------------------------------------ labels and folds
def test_maturity_and_usability(spark):
    xy = spark.createDataFrame([(D("2024-04-29"), D("2024-05-10"), D("2024-05-11"), "ok", 0.1), (D("2024-05-06"), D("2024-05-17"), D("2024-05-18"), "ok", 0.2), (D("2024-04-29"), D("2024-05-10"), D("2024-05-11"), "schedule_skip", None)], "as_of date, label_end_at date, label_available_at date, label_status string, y_excess double")
    assert [r.y_excess for r in forecast.mature(xy, "2024-05-13").collect()] == [0.1]
    u = spark.createDataFrame([(D("2024-05-01"), D("2024-05-13")), (D("2024-05-01"), D("2024-05-12"))], "event_at date, available_at date")
    assert forecast.usable(u, F.lit("2024-05-13").cast("date")).count() == 1


def test_inner_blocks():
    weeks = [D("2020-01-06") + dt.timedelta(7 * i) for i in range(200)]
    b = forecast.inner_blocks(weeks)
    assert len(b) == 3 and [x[1] for x in b] == sorted(x[1] for x in b) and b[-1][2] == weeks[-1]


def test_members(spark):
    u = spark.createDataFrame([("a", D("2024-06-01"), None, "T")], "ticker string, listing_date date, delisting_date date, venue string")
    v = spark.createDataFrame([], "ticker string, effective_from date, effective_to date, venue string")
    at = spark.createDataFrame([(D("2024-05-06"),), (D("2024-07-01"),)], "as_of date")
    assert rows(forecast.members(u, v, at), "as_of", "status", "venue") == [(D("2024-05-06"), "pre_listing", "T"), (D("2024-07-01"), "active", "T")]


def test_feature_guard():
    assert forecast.check_columns(["a", "a", "b"], {"a", "b"}) == ["a", "b"]
    with pytest.raises(ValueError):
        forecast.check_columns(["y_next"], forbidden={"y_next"})


# ------------------------------------------------------------------ evaluation
def test_gain_gate(spark):
    d = spark.createDataFrame([(0.0579, 0.0060, -0.0004, 4), (0.05, 0.01, 0.001, 3)], "ic double, delta double, lo double, years int")
    g = evaluate.gain_gate(F.col("ic"), F.col("delta"), F.col("lo"), F.col("years"))
    assert [r.o for r in d.select(g["gain"].alias("o")).collect()] == [False, True]


def test_nav(spark):
    d = spark.createDataFrame([("s", 1, 1_000_000.0), ("s", 2, 980_000.0)], "strategy string, as_of int, nav double")
    r = evaluate.nav_metrics(d, initial=1_000_000.0).first()
    assert r.total_return == pytest.approx(-0.02) and r.max_drawdown == pytest.approx(-0.02)


def test_rank_ic_and_auc(spark):
    rng = np.random.default_rng(0)
    p, y = rng.normal(size=400).round(1), rng.normal(size=400)
    pdf = pd.DataFrame({"as_of": 1, "p": p, "y": y + p, "ticker": range(400)})
    d = spark.createDataFrame(pdf)
    assert evaluate.weekly_rank_ic(d, "p", "y").first().ic == pytest.approx(pdf.p.rank().corr(pdf.y.rank()))
    assert evaluate.weekly_rank_ic(d.withColumn("p", F.lit(1.0)), "p", "y").first().ic is None
    q = d.select((1 / (1 + F.exp(-F.col("p")))).alias("q"), (F.col("y") > 0).cast("int").alias("h"))
    pos, neg = p[pdf.y > 0], p[pdf.y <= 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert evaluate.classification(q, "q", "h").first().roc_auc == pytest.approx(want)


def test_bootstrap_brackets_mean(spark):
    d = spark.createDataFrame([(i, float(i % 7)) for i in range(100)] + [(200, None)], "as_of int, x double")
    r = evaluate.block_bootstrap(d, "x", reps=200).first()
    assert r.n == 100 and r.ci_low < r["mean"] < r.ci_high and evaluate.block_bootstrap(d, "x", reps=200).first() == r


# ------------------------------------------------------------------ ledger
def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    new = spark.createDataFrame([("r", D("2024-05-06"), "a", "1w", "m", 0.1)], "run_id string, as_of date, ticker string, horizon string, model_version string, pred double")
    ledger.append_immutable(spark, new, path)
    with pytest.raises(ValueError):
        ledger.append_immutable(spark, new, path)
    ledger.append_missing(spark, new.select("as_of"), str(tmp_path / "skips"), ["as_of"])
    ledger.append_missing(spark, new.select("as_of"), str(tmp_path / "skips"), ["as_of"])
    assert ledger.read_or_none(spark, str(tmp_path / "skips")).count() == 1
    later = new.withColumns({"pred": F.lit(0.2)})
    assert [r.pred for r in ledger.keep_last(new, later, ["ticker"], "as_of").collect()] == [0.2]


def test_model_store(spark, tmp_path):
    d = spark.createDataFrame([(float(i), float(i % 5) if i % 4 else None, 2.0 * i + 1) for i in range(40)], "a double, b double, y double")
    m = models.ridge(d, ["a", "b"], "y", 0.1)
    ledger.save_model(spark, m, "2024-05-06", str(tmp_path / "m"))
    again = ledger.load_model(spark, "2024-05-06", str(tmp_path / "m"))
    one, two = ([v for (v,) in rows(x.predict(d.select("a", "b")), "pred")] for x in (m, again))
    assert one == pytest.approx(two)


# ------------------------------------------------------------------ trading
def test_minimum_fee_and_account():
    c = backtest.Costs()
    assert c.fee(1000) == 20
    week = pd.DataFrame({"as_of": [1, 1, 1], "ticker": ["a", "b", "c"], "rank": [1, 2, 3], "n_obs": [20, 5, 20], "adv": [1e8, np.nan, 1e3], "px_in": [10.0, 10.0, 10.0], "px_out": [11.0, 11.0, 11.0], "entry_at": 1, "label_end_at": 2}).assign(**{f: getattr(c, f) for f in backtest.COST_FIELDS})
    orders, nav = backtest.account(week)
    assert [(o["ticker"], o["status"]) for o in orders] == [("a", "filled"), ("a", "filled"), ("b", "insufficient_adv_history"), ("c", "rejected_adv")]
    assert nav[-1]["nav"] > 1e6


def plain_account(weeks, costs_on, cash, max_weight, min_adv, share):
    """Weekly round trips one by one; returns nav, fees, turnover per week."""
    out = []
    for at, names in weeks:
        rate, tax, slip, least, lot = costs_on(at)
        start, fees, turnover, gain, free = cash, 0.0, 0.0, 0.0, cash
        for adv, px_in, px_out in names:
            if adv is None or adv < min_adv or px_in is None or px_out is None:
                continue
            money = min(start * max_weight, free)
            if money <= 0:
                break
            price = px_in * (1 + slip)
            n = math.floor(min(money, adv * share) / price / lot) * lot
            fee = max(least, n * price * rate)
            if n <= 0 or n * price + fee > free:
                continue
            free -= n * price + fee
            got = n * px_out * (1 - slip)
            sold = max(least, got * rate) + got * tax
            fees += fee + sold
            turnover += n * price + got
            gain += got - sold
        cash = free + gain
        out.append((at, cash, fees, turnover))
    return out


def test_backtest_under_changing_costs_equals_a_plain_one(spark):
    rng = np.random.default_rng(4)
    weeks, rows_ = [], []
    for w in range(30):
        at = D("2020-01-06") + dt.timedelta(7 * w)
        names = [(None if rng.random() < 0.1 else float(rng.uniform(1e5, 1e8)), None if rng.random() < 0.1 else float(rng.uniform(5, 200)), float(rng.uniform(5, 200))) for _ in range(8)]
        weeks.append((at, names))
        rows_ += [(at, f"t{i}", i + 1, at, at + dt.timedelta(4), 20 if a else 5, a, p, q) for i, (a, p, q) in enumerate(names)]
    cands = spark.createDataFrame(rows_, "as_of date, ticker string, rank int, entry_at date, label_end_at date, n_obs int, adv double, px_in double, px_out double")
    change = D("2020-04-06")
    schedule = spark.createDataFrame([(D("2000-01-01"), 0.001425, 0.6, 0.003, 20.0, 20.0, 1000), (change, 0.001425, 0.28, 0.0045, 10.0, 1.0, 1)], "effective_from date, fee_rate double, fee_discount double, tax_rate_sell double, slippage_bps double, min_fee double, lot_size int")
    on = lambda at: (0.001425 * 0.28, 0.0045, 0.001, 1.0, 1) if at >= change else (0.001425 * 0.6, 0.003, 0.002, 20.0, 1000)
    want = plain_account(weeks, on, 1e6, 0.2, 1e6, 0.01)
    nav = [r for r in backtest.simulate(cands, schedule, max_weight=0.2, min_adv=1e6).collect() if not r.is_initial]
    got = sorted((r.as_of, r.nav, r.fees, r.turnover) for r in nav)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in want], rtol=1e-12)
    assert got[0][2] > 0 and all(r.cash == r.nav and r.n_positions_carried == 0 for r in nav)
    t = backtest.totals(backtest.simulate(cands, schedule, max_weight=0.2, min_adv=1e6), 1e6).first()
    assert t.total_fees == pytest.approx(sum(w[2] for w in want)) and t.total_turnover == pytest.approx(sum(w[3] for w in want)) and t.total_return == pytest.approx(want[-1][1] / 1e6 - 1)
    with pytest.raises(Exception, match="no cost schedule"):
        backtest.simulate(cands, schedule.where("effective_from > '2020-02-01'")).collect()


def test_benchmark_accounts(spark):
    spans = spark.createDataFrame([(D("2020-01-06"), 10.0, 11.0), (D("2020-01-13"), None, 12.0), (D("2020-01-20"), 12.0, 9.0)], "as_of date, px_in double, px_out double")
    c = backtest.Costs(fee_rate=0.001, fee_discount=1.0, tax_rate_sell=0.0, slippage_bps=0.0, min_fee=0.0, lot_size=1)
    hold = [r.nav for r in backtest.benchmark_account(spans, c, 1000.0, hold=True).orderBy("as_of").collect()]
    assert hold == pytest.approx([-1 + 100 * 11.0, -1 + 100 * 12.0, -1 + 100 * 9.0])
    week = [r.nav for r in backtest.benchmark_account(spans, c, 1000.0).orderBy("as_of").collect()]
    first = 1000 + 100 - 1 - 1.1
    n = int(first / 12)
    assert week == pytest.approx([first, first, first - 3 * n - 0.001 * n * 21])


def test_adv_gate(spark):
    daily = spark.createDataFrame([("a", D("2024-01-01") + dt.timedelta(i), 10.0) for i in range(25)] + [("b", D("2024-01-01") + dt.timedelta(i), 10.0) for i in range(5)], "ticker string, date date, value double")
    ask = spark.createDataFrame([("a", D("2024-02-01")), ("b", D("2024-02-01")), ("c", D("2024-02-01"))], "ticker string, as_of date")
    assert rows(market.adv_at(ask, daily).na.fill(-1), "ticker", "n_obs", "adv") == [("a", 20, 10.0), ("b", 5, -1.0), ("c", 0, -1.0)]


# ------------------------------------------------------------------ matching of texts
def test_every_class_of_evidence(spark):
    from panelforge.plans.q_text import CASE_DICTIONARY, CASES

    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, body string").withColumn("title", F.lit(None).cast("string"))
    got = {r.i: {f.entity: f.mode for f in r.found} for r in matcher.mentions(d, CASE_DICTIONARY).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(CASES)} == dict(CASES)


def test_bridge_and_spellings(spark):
    names = matcher.Dictionary([matcher.Name("1101", "海岸水泥"), matcher.Name("1102", "海岸", "name_with_context")])
    d = spark.createDataFrame([("x", "海岸水泥", "1102 續抱"), ("y", None, None)], "article_id string, title string, body string")
    assert rows(matcher.bridge(d, names), "article_id", "ticker", "match_mode") == [("x", "1101", "name"), ("x", "1102", "code")]
    assert [(n.text, n.mode) for n in matcher.name_variants("1", "長名-KY", group=("長名-KY", "長名電子"))] == [("長名", "name_with_context"), ("長名-KY", "name_with_context")]
    assert [(n.text, n.mode) for n in matcher.name_variants("1", "長名電子", extra=("長電",), group=("長名-KY", "長名電子"))] == [("長名電子", "name"), ("長電", "name")]
    assert [(n.text, n.mode, n.priority) for n in matcher.name_variants("2", "三字名", override=("全名",))] == [("全名", "name", 2)]
    assert matcher.Dictionary([]).codes == frozenset()


def test_prefix_tree_takes_the_longest(spark):
    words = ["ab", "abc", "abcd", "b", "bcx", "a.c"]
    tree = matcher.prefix_tree(words)
    text = "xabcx abcd a.c abx bcx ab"
    got = [(s.start, s.end, s.word) for s in spark.range(1).select(arrays.occurrences(F.lit(text), tree).alias("o")).first().o]
    want = [(i, i + len(w), w) for i in range(len(text)) if (w := max((w for w in words if text.startswith(w, i)), key=len, default=None))]
    assert got == want


def test_articles_to_panel(spark, tmp_path):
    """Files of articles -> matches -> weekly counts -> a panel with look-backs, in one go."""
    from panelforge.sources import readers

    for i, (title, body, at) in enumerate([("[標的] 海岸水泥 多", "進場", 1715000000), ("Re: [新聞] 東林鋼業", "股價", 1715700000), ("[心得] 雜記", "無關", 1715700001), ("[標的] 4101 與 東林鋼業", "", 1716300000)]):
        (tmp_path / f"M.{at}.{i}.json").write_text(json.dumps({"article_id": f"a{i}", "title": title, "body": body, "timestamp": at, "pushes": ["x"]}), encoding="utf-8")
    from panelforge.plans.q_text import CASE_DICTIONARY

    hits = matcher.bridge(readers.articles(spark, str(tmp_path)), CASE_DICTIONARY)
    flagged = panel.bulk_flag(hits, "article_id", "ticker", 1).where("NOT is_bulk")
    counts = panel.counts(flagged.withColumn("week", T.week_of(F.col("posted_at").cast("date"))), ["ticker", "week"], {"att_all": None, "att_high": F.col("effort") == "high_effort"})
    cells = panel.grid(counts.select("ticker").distinct(), "ticker", F.lit("2024-05-12").cast("date"), F.lit("2024-05-26").cast("date"))
    full = panel.fill_counts(cells, counts, ["ticker", "week"])
    assert rows(full, "ticker", "week", "att_all", "att_high") == [("4101", D("2024-05-12"), 1, 1), ("4101", D("2024-05-19"), 0, 0), ("4101", D("2024-05-26"), 0, 0), ("4104", D("2024-05-12"), 0, 0), ("4104", D("2024-05-19"), 1, 0), ("4104", D("2024-05-26"), 0, 0)]


# ------------------------------------------------------------------ percentiles, loop, settings
def test_exact_percentiles(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=30_001), "b": rng.integers(0, 5, 30_001).astype(float), "c": np.nan, "d": np.r_[np.full(20_000, 7.0), rng.normal(size=10_001)]})
    pdf.loc[::7, "a"] = np.nan
    d = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in "abcd"])
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    got = {r.variable: (r.n, r.q) for r in exact_percentiles(d, list("abcd"), probs).collect()}
    assert got["c"] == (0, [None] * 7)
    for c in "abd":
        x = pdf[c].dropna().to_numpy()
        assert got[c][0] == len(x) and np.allclose(got[c][1], np.quantile(x, probs), rtol=1e-12, atol=1e-12)


def test_prospective_loop(spark, tmp_path):
    rng = np.random.default_rng(2)
    weeks = [D("2020-01-06") + dt.timedelta(7 * i) for i in range(40)]
    feats = spark.createDataFrame([(f"t{i}", w, "dense" if i < 30 else None, float(rng.normal()), float(rng.normal())) for w in weeks for i in range(35)] + [("t0", D("2021-01-04"), "dense", 0.0, 0.0)], "ticker string, as_of date, sparsity_tier string, f1 double, f2 double")
    lab = feats.where("as_of < '2020-12-31'").select("ticker", "as_of", (F.col("f1") * 0.1).alias("y_excess"), F.date_add("as_of", 5).alias("label_end_at"), F.date_add("as_of", 6).alias("label_available_at"), F.lit("ok").alias("label_status"))
    loop = prospective.Loop(str(tmp_path / "p"), {"m1": ["f1"], "m2": ["f1", "f2"]}, alpha=0.1)
    got = prospective.backfill(spark, feats, lab, 3, loop)
    assert [(g["as_of"], g["status"], g.get("reason")) for g in got] == [(weeks[-2], "predicted", None), (weeks[-1], "predicted", None), (D("2021-01-04"), "skipped", "insufficient_universe")]
    again = prospective.backfill(spark, feats, lab, 2, loop)
    assert [g.get("reason") for g in again] == ["duplicate_as_of", "insufficient_universe"]
    assert prospective.predict(spark, feats, lab, D("2019-01-07"), loop)["reason"] == "as_of_not_in_features"
    kept = ledger.read_or_none(spark, loop.table("predictions"))
    assert kept.count() == 70 and ledger.read_or_none(spark, loop.table("skips")).count() == 2
    pair = kept.join(feats.select("ticker", "as_of", "f1"), ["ticker", "as_of"]).agg(F.corr("pred_m1", "f1"), F.corr("pred_m2", "f1")).first()
    assert min(pair) > 0.99
    assert [prospective.score(spark, lab, weeks[-1], loop).count() for _ in range(2)] == [35, 35]
    assert prospective.score(spark, lab, D("2021-06-01"), loop).count() == 70
    ex = spark.createDataFrame([(x,) for x in (weeks[0], weeks[-1], D("2021-01-04"))], "as_of date")
    assert rows(prospective.report(spark, ex, loop), "as_of", "status") == [(weeks[0], "missing"), (weeks[-1], "predicted"), (D("2021-01-04"), "skipped")]


def test_selection_of_c_and_calibration(spark):
    rng = np.random.default_rng(3)
    weeks = [D("2020-01-06") + dt.timedelta(7 * i) for i in range(20)]
    xy = spark.createDataFrame([(w, float(x), int(x + rng.normal() > 0)) for w in weeks for x in rng.normal(size=40)], "as_of date, x double, y int").select("*", F.date_add("as_of", 5).alias("label_end_at"), F.date_add("as_of", 6).alias("label_available_at"), F.lit("ok").alias("label_status"))
    assert models.validation_blocks(xy, 3, 26, 104) == [(weeks[-5], weeks[-5], weeks[-1] + dt.timedelta(1))]
    blocks = dict(n_blocks=2, size=5, least_weeks=8)
    assert [b[1] for b in models.validation_blocks(xy, **blocks)] == [weeks[10], weeks[15]]
    best, record = models.select_c(xy, ["x"], "y", (1e-6, 1.0), **blocks)
    by = {r.c: (r.mean_brier, r.n_blocks) for r in record.collect()}
    assert best == 1.0 and by[1.0][0] < by[1e-6][0] and by[1.0][1] == 2
    slope, _ = models.calibrated(xy, ["x"], "y", 1.0, **blocks)
    assert slope > 0 and models.out_of_fold(xy, ["x"], "y", 1.0, **blocks).count() == 400
    assert models.calibrated(xy.limit(0), ["x"], "y", 1.0) is None


def test_logit_and_statsless_cases(spark):
    d = spark.createDataFrame([(float(i), int(i > 500)) for i in range(1000)] + [(1e5, 1), (-1e5, 0)], "x double, y int")
    assert math.isfinite(estimators.logit(d, "y", ["x"], rounds=4)["pseudo_r2"])
    assert forecast.feature_set("e")[:2] == ["ret", "ret_lag1"] and len(forecast.feature_set("B")) == len(set(forecast.feature_set("B")))
    with pytest.raises(ValueError):
        forecast.check_columns([*forecast.feature_set("A"), "ret_next"], forbidden=set(forecast.FORBIDDEN))


def test_settings(tmp_path):
    from panelforge.sources import config

    (tmp_path / "s.json").write_text(json.dumps({"data": {"out": "x/y", "lake": "s3://b/z"}, "a": {"b": 2}}))
    c = config.load(tmp_path / "s.json", {"a": {"b": 1, "c": 3}, "d": 4})
    assert c["a"] == {"b": 2, "c": 3} and c["d"] == 4
    assert config.resolve(c, "out") == str(tmp_path.resolve() / "x/y") and config.resolve(c, "lake") == "s3://b/z"
    with pytest.raises(KeyError):
        config.resolve(c, "none")


# ------------------------------------------------------------------ estimators
def test_two_way_unbalanced_equals_dummies(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame([(i, t) for i in range(12) for t in range(15) if rng.random() < 0.8], columns=["ticker", "week"])
    pdf["x"] = rng.normal(size=len(pdf)) + pdf.ticker * 0.1
    pdf["y"] = 0.7 * pdf.x + pdf.ticker * 0.3 - pdf.week * 0.2 + rng.normal(size=len(pdf)) * 0.1
    fit = estimators.fit_two_way(spark.createDataFrame(pdf), "y", ["x"], gates=(10, 5, 5))
    X = np.column_stack([pdf.x, pd.get_dummies(pdf.ticker).to_numpy(float), pd.get_dummies(pdf.week).to_numpy(float)[:, 1:]])
    beta = np.linalg.lstsq(X, pdf.y.to_numpy(), rcond=None)[0]
    assert fit.params["x"] == pytest.approx(beta[0], abs=1e-9) and fit.stderr["x"] > 0
    assert estimators.fit_two_way(spark.createDataFrame(pdf), "y", ["x"]).status == "SKIPPED"


def test_logit_and_ridge(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=800)
    pdf = pd.DataFrame({"x": x, "y": (rng.random(800) < 1 / (1 + np.exp(-(0.5 + x)))).astype(int)})
    f = estimators.logit(spark.createDataFrame(pdf), "y", ["x"])
    p = 1 / (1 + np.exp(-(f["beta"][0] + f["beta"][1] * x)))
    assert abs((pdf.y - p).sum()) < 1e-6 and abs(((pdf.y - p) * x).sum()) < 1e-6
    r = models.ridge(spark.createDataFrame(pdf), ["x"], "y", 10.0)
    z = (x - x.mean()) / x.std()
    assert r.weights["z_x"] == pytest.approx((z @ (pdf.y - pdf.y.mean())) / (z @ z + 10.0))


def test_student_t():
    assert estimators.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert estimators.t_cdf(0.0, 3) == pytest.approx(0.5)


def test_newey_west(spark):
    x = np.sin(np.arange(60) / 3) + 1
    r = estimators.newey_west(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t int, x double"), "x", "t").first()
    e = x - x.mean()
    var = e @ e + 2 * sum((1 - k / 5) * (e[k:] @ e[:-k]) for k in range(1, 5))
    assert r.se == pytest.approx(np.sqrt(var) / 60)


# ------------------------------------------------------------------ matching of events
def test_matching_caliper(spark):
    rng = np.random.default_rng(3)
    out = []
    for w in range(6):
        for i in range(60):
            path = [float(v) for v in rng.normal(scale=0.01, size=13)]
            out.append((f"t{i}", D("2024-01-07") + dt.timedelta(7 * w), "dense", i < 5, path, float(rng.normal()), float(rng.normal())))
    d = spark.createDataFrame(out, "ticker string, week date, sparsity_tier string, event boolean, path array<double>, log_mktcap double, log_turnover double")
    pairs = research.match_pairs(research.candidates(d, "event"), k=1).collect()
    assert pairs and all(p.t_ticker != p.c_ticker for p in pairs)
    assert all(abs(p[f"t_{v}"] - p[f"c_{v}"]) <= research.CALIPER for p in pairs for v in research.RETURN_VARS)
    # nearest of the allowed ones, by brute force in one block
    cands = research.candidates(d, "event").toPandas()
    g = cands[cands.week == D("2024-01-07")]
    z = ((g[list(research.MATCH_VARS)] - g[list(research.MATCH_VARS)].mean()) / g[list(research.MATCH_VARS)].std()).to_numpy()
    want = {}
    for a in np.flatnonzero(g.treated.to_numpy()):
        best = [(float(((z[a] - z[b]) ** 2).sum()), g.ticker.iloc[b]) for b in np.flatnonzero(~g.treated.to_numpy()) if all(abs(g[v].iloc[a] - g[v].iloc[b]) <= research.CALIPER for v in research.RETURN_VARS)]
        if best:
            want[g.ticker.iloc[a]] = min(best)[1]
    assert {p.t_ticker: p.c_ticker for p in pairs if p.week == D("2024-01-07")} == want
