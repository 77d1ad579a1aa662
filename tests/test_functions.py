"""Time, window and text columns against hand-worked values."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import text as X
from panelforge.functions import timeops as T
from panelforge.functions import windows as W

D = dt.date.fromisoformat


def column(spark, values, kind, f):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in d.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def series(spark, xs, f):
    d = spark.createDataFrame([("a", D("2024-01-07") + dt.timedelta(7 * i), x) for i, x in enumerate(xs)], "e string, week date, x double")
    w = W.by("e", "week")
    return [r.o for r in d.select("week", f(F.col("x"), w).alias("o")).orderBy("week").collect()]


def test_weeks(spark):
    days = [D("2024-05-06"), D("2024-05-12"), D("2024-05-13"), None]
    assert column(spark, days, "date", T.week_of) == [D("2024-05-12"), D("2024-05-12"), D("2024-05-19"), None]
    assert column(spark, [D("2024-05-12")], "date", T.as_of) == [D("2024-05-13")]
    assert column(spark, [D("2024-05-13"), D("2024-05-14")], "date", T.feature_week) == [D("2024-05-12"), None]
    assert column(spark, [D("2024-05-13"), D("2024-05-12")], "date", T.latest_feature_week) == [D("2024-05-12"), D("2024-05-05")]
    assert column(spark, [2024, 2023, 2022], "int", T.first_monday) == [D("2024-01-01"), D("2023-01-02"), D("2022-01-03")]


def test_sessions(spark):
    rows = [("2024-05-06 09:00", True, "intraday"), ("2024-05-06 13:29", True, "intraday"), ("2024-05-06 13:30", True, "non_trading"), ("2024-05-06 08:59", True, "non_trading"), ("2024-05-11 10:00", None, "non_trading")]
    d = spark.createDataFrame([(dt.datetime.fromisoformat(a), b, c) for a, b, c in rows], "ts timestamp_ntz, open boolean, want string")
    assert d.where(T.session_window(F.col("ts"), F.col("open")) != F.col("want")).count() == 0


def test_roc_dates(spark):
    got = column(spark, ["1150904", "20240131", "109年01月16日", "111/01/06", "111/13/06", "x", None, " 99/2/3 "], "string", T.roc_date)
    assert got == [D("2026-09-04"), D("2024-01-31"), D("2020-01-16"), D("2022-01-06"), None, None, None, D("2010-02-03")]


def test_abnormal_levels(spark):
    assert series(spark, [0.0] * 8 + [10.0], W.abnormal)[:8] == [None] * 8
    assert series(spark, [0.0] * 8 + [10.0], W.abnormal)[8] == pytest.approx(math.log(11))
    assert series(spark, [5.0] * 9, W.abnormal)[8] == pytest.approx(0)
    assert series(spark, [4.0] * 8 + [0.0], W.abnormal)[8] == pytest.approx(-math.log(5))
    assert series(spark, [4.0] * 8 + [0.0], lambda x, w: W.abnormal(x, w, positive_only=True))[8] is None


def test_initiation_and_tiers(spark):
    assert series(spark, [0.0] * 8 + [3.0, 5.0], W.initiation) == [False] * 8 + [True, False]
    assert series(spark, [0.0] * 9 + [7.0], W.zero_base) == [False] * 8 + [True, True]
    assert column(spark, [0, 3, 4, 39, 40, 52, None], "int", W.sparsity_tier) == ["silent", "silent", "sparse", "sparse", "dense", "dense", None]


def test_contiguous_lead(spark):
    weeks = ["2024-01-07", "2024-01-14", "2024-01-28"]
    d = spark.createDataFrame([("a", D(x), float(i)) for i, x in enumerate(weeks)], "e string, week date, x double")
    w = W.by("e", "week")
    assert [r.o for r in d.select("week", W.lead_contiguous(F.col("x"), F.col("week"), 1, w).alias("o")).orderBy("week").collect()] == [1.0, None, None]


def test_fills_products_and_momentum(spark):
    assert series(spark, [None, None, 1000.0, None], W.ffill) == [None, None, 1000.0, 1000.0]
    assert series(spark, [None, 2.0, None], lambda x, w: W.bfill(x, "e", "week")) == [2.0, 2.0, None]
    assert series(spark, [0.9, 2.0], lambda x, w: W.suffix_product(x, "e", "week")) == pytest.approx([1.8, 2.0])
    got = series(spark, [0.1, 0.2, None, 0.3], lambda x, w: W.momentum(x, 4, w))
    assert got[:2] == [None, None] and got[2] == pytest.approx(0.32) and got[3] == pytest.approx(0.32)


@pytest.mark.parametrize("n", [25, 26, 31, 50, 99, 7])
def test_quantile_buckets_equal_pandas(spark, n):
    d = spark.range(n).select(F.col("id").alias("k"), F.lit(0).alias("g"), F.sin(F.col("id") * 3).alias("x"))
    got = d.select("k", W.qcut_first(F.col("x"), 5, ["g"], "k").alias("b")).orderBy("k").collect()
    x = pd.Series([math.sin(3 * i) for i in range(n)]).rank(method="first")
    assert [r.b for r in got] == list(pd.qcut(x, 5, labels=False) + 1)


def test_average_rank(spark):
    d = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 2.0), (3, 5.0)], "k int, x double").withColumn("g", F.lit(0))
    assert [r.r for r in d.select("k", W.average_rank(F.col("x"), ["g"]).alias("r")).orderBy("k").collect()] == [2.5, 1.0, 2.5, 4.0]


def test_safe_corr(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "a double, b double")
    assert d.agg(W.safe_corr("a", "b")).first()[0] is None
    e = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5), (None, 1.0)], "a double, b double")
    assert e.agg(W.safe_corr("a", "b")).first()[0] == pytest.approx(pd.Series([1, 2, 3]).corr(pd.Series([2, 4, 6.5])))


def test_titles(spark):
    titles = ["[標的] 2330 多", "Re: [標的] x", "Fw: Re: [新聞] y", "[雜談] z", "no tag", "Re: no tag", None, "[這個標籤太長了吧] q"]
    assert column(spark, titles, "string", X.title_category) == ["標的", "標的", "新聞", "其他", "未分類", "未分類", "未分類", "未分類"]
    assert column(spark, titles, "string", X.is_reply) == [False, True, True, False, False, True, False, False]
    effort = lambda t: X.effort_tier(X.title_category(t), X.is_reply(t))
    assert column(spark, titles[:4], "string", effort) == ["high_effort", "mid_effort", "low_effort", "unclassified"]


def test_markup_numbers_stars(spark):
    assert column(spark, ["<p>a &lt;b&gt; &amp;amp; c</p>", None], "string", X.strip_html) == ["a &amp; c", None]
    assert column(spark, ["1,234.5", "--", "-3", "0", None], "string", lambda c: X.number(c, True)) == [1234.5, None, None, None, None]
    assert column(spark, ["1,234", "", "-5 "], "string", X.shares) == [1234.0, 0.0, -5.0]
    assert column(spark, [3.0, 2.0, 1.7, 1.0], "double", X.stars) == ["***", "**", "*", ""]
    kept = column(spark, ["keep\n(例 2330 台積電)\nrest", "按 ctrl+y 刪除\nx"], "string", X.strip_template)
    assert kept == ["keep\n\nrest", "\nx"]
    assert column(spark, ["a xx b xx c"], "string", lambda c: X.snippets(c, "xx", 3)) == [["a 【xx】 b ", " b 【xx】 c"]]
