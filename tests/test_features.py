"""Feature sets: every name is built, and nothing that must not be known gets in."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.operators import forecast, panel

D = dt.date.fromisoformat


@pytest.fixture(scope="module")
def weeks(spark):
    rows = [(e, D("2020-01-05") + dt.timedelta(7 * t), (t * 7 + e * 3) % 5, (t + e) % 3, 0.01 * ((t * 13 + e) % 7 - 3), 100.0 * (t % 4), 0.1, t % 2) for e in (1, 2) for t in range(20)]
    return spark.createDataFrame(rows, "ticker long, week date, att_all long, att_weekend long, ret double, value double, amihud double, zero_volume_days long")


def test_every_name_is_built_without_optional_inputs(spark, weeks):
    x = panel.attention_block(weeks.withColumn("att_weekday", F.col("att_all") - F.least("att_all", "att_weekend")))
    bench = weeks.where("ticker = 1").select("week", F.col("ret").alias("bench_ret"))
    x = forecast.engineer(x, bench).withColumns({"as_of": F.date_add("week", 1), "ret_lag1": F.lit(0.0)})
    x = forecast.attach_sources(x)
    for name in forecast.SETS:
        got = forecast.feature_matrix(x, name)
        assert set(got.columns) == {"ticker", "week", *forecast.feature_set(name)} and got.count() == 40
    r = x.where("ticker = 1").orderBy("week").collect()
    assert all(q.log_market_cap is None and q.missing_market_cap == 1 and q.missing_news == 1 and q.missing_revenue == 1 and q.is_code_only_matched == 0 for q in r)
    assert r[7].abn_attention_all is None and r[8].abn_attention_all is not None


def test_matrix_is_guarded(weeks):
    with pytest.raises(ValueError, match="not built"):
        forecast.feature_matrix(weeks, "A")
    with pytest.raises(ValueError, match="not allowed"):
        forecast.check_columns(["ret", "ret_next"], None, set(forecast.FORBIDDEN))


def test_sources_attach(spark):
    rows = spark.createDataFrame([(1, D("2020-02-10")), (2, D("2020-02-10"))], "ticker long, as_of date")
    news = spark.createDataFrame([(1, dt.datetime(2020, 2, 5, 10)), (1, dt.datetime(2020, 2, 9, 12))], "ticker long, publish_at timestamp")
    rev = spark.createDataFrame([(1, D("2020-02-09"), 100.0, 0.5, float("inf")), (1, D("2020-02-10"), 1.0, 1.0, 1.0)], "ticker long, announce_date date, revenue double, revenue_yoy double, revenue_mom double")
    got = {r.ticker: r for r in forecast.attach_sources(rows, news, rev).collect()}
    assert got[1].log1p_news_count_1w == pytest.approx(0.6931471805599453) and got[1].missing_news == 0 and got[2].log1p_news_count_4w == 0.0
    assert got[1].revenue_yoy_latest == 0.5 and got[1].revenue_mom_latest is None and got[1].days_since_revenue_announce == 1 and got[1].missing_revenue == 0
    assert got[2].revenue_yoy_latest is None and got[2].missing_revenue == 1
    empty = forecast.attach_sources(rows, news.where("false"), rev.where("false")).first()
    assert empty.missing_news == 1 and empty.log1p_news_count_1w is None and empty.missing_revenue == 1


def test_initiations_by_part_of_the_week(spark):
    rows = [(1, D("2020-01-05") + dt.timedelta(7 * t), n, w, n - w) for t, (n, w) in enumerate([(0, 0)] * 8 + [(2, 2), (0, 0)] + [(0, 0)] * 8 + [(1, 0)])]
    d = spark.createDataFrame(rows, "ticker long, week date, att_all long, att_weekend long, att_weekday long")
    got = {r.week: (r.is_initiation, r.is_initiation_weekend, r.is_initiation_weekday) for r in panel.attention_block(d).collect()}
    assert got[D("2020-03-01")] == (True, True, False) and got[D("2020-05-10")] == (True, False, True)
    assert sum(any(v) for v in got.values()) == 2
