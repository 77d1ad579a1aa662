"""Readers of raw layouts, sinks, and the specification batteries."""

import datetime as dt
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import specs
from panelforge.sources import readers, sinks

D = dt.date.fromisoformat


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_articles(spark, tmp_path):
    put(tmp_path / "a/M.1715000000.A.json", {"article_id": "1", "title": "Re: [標的] x", "body": "b", "pushes": ["p", "q"]})
    put(tmp_path / "b/M.9.json", {"article_id": "2", "title": "[新聞] y", "body": "", "timestamp": 1715000001})
    r = {x.article_id: x for x in readers.articles(spark, str(tmp_path)).collect()}
    assert r["1"].timestamp == 1715000000 and r["1"].effort == "mid_effort" and r["1"].n_pushes == 2
    assert r["2"].posted_at == dt.datetime(2024, 5, 6, 20, 53, 21) and r["2"].effort == "low_effort" and r["2"].n_pushes == 0
    put(tmp_path / "c/M.8.json", "{broken")
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        readers.articles(spark, str(tmp_path)).collect()


def test_prices_and_institutions(spark, tmp_path):
    put(tmp_path / "p/1.json", {"data": [{"date": "2024-05-06", "stock_id": "0050", "Trading_Volume": 5, "Trading_money": 50, "open": 0, "max": 11, "min": 9, "close": 10, "Trading_turnover": 1}]})
    r = readers.prices(spark, str(tmp_path / "p")).first()
    assert (r.ticker, r.open, r.close, r.value) == ("0050", None, 10.0, 50.0)
    put(tmp_path / "e/1.json", {"data": []})
    with pytest.raises(ValueError):
        readers.prices(spark, str(tmp_path / "e"))
    put(tmp_path / "i/1.json", {"data": [{"date": "2024-05-06", "stock_id": "1", "name": n, "buy": b, "sell": 1} for n, b in (("x", 2), ("y", 3))]})
    assert [(x.inst_buy, x.inst_sell) for x in readers.institutions(spark, str(tmp_path / "i")).collect()] == [(5, 2)]


def test_positional_layouts(spark, tmp_path):
    put(tmp_path / "T_20150105.json", {"fields": ["code", "name", "buy"], "data": [["2330 ", "n", "1,234"], ["00632R", "n", "9"]]})
    put(tmp_path / "T_20180105.json", {"fields": ["code", "extra", "name", "buy"], "data": [["2330", "z", "n", ""]]})
    out = sorted((r.date, r.ticker, r.n_fields, r.bought) for r in readers.positional(spark, str(tmp_path), "code", {"bought": "buy"}).collect())
    assert out == [(D("2015-01-05"), "2330", 3, 1234.0), (D("2018-01-05"), "2330", 4, 0.0)]
    rows = readers.positional(spark, str(tmp_path), "code", {"bought": "buy"}, spark.createDataFrame([("2330",), ("2330",)], "ticker string"))
    assert sorted(tuple(r) for r in readers.layouts(rows).collect()) == [(3, 1, 1, D("2015-01-05"), D("2015-01-05")), (4, 1, 1, D("2018-01-05"), D("2018-01-05"))]
    assert readers.positional(spark, str(tmp_path), "code", {"bought": "buy"}, spark.createDataFrame([("1101",)], "ticker string")).count() == 0


def test_vendor_csv_revenue_events(spark, tmp_path):
    put(tmp_path / "v.csv", "﻿Date,Adj Close\n2024-05-06,1\n2024-05-06,2\n2024-05-07,3\n")
    assert [(r.date, r.adj_close) for r in readers.vendor_csv(spark, str(tmp_path / "v.csv")).orderBy("date").collect()] == [(D("2024-05-06"), "1"), (D("2024-05-07"), "3")]
    put(tmp_path / "w/0050.csv", "Date,Open,Close\n2024-05-06,10,9\n2024-05-07,x,20\n")
    put(tmp_path / "w/1101.csv", "Date,Open,Close\n2024-05-06,1,2\n")
    ev = spark.createDataFrame([("0050", D("2024-05-07"), "reduction", 10.0, 20.0)], "ticker string, date date, kind string, before_price double, after_price double")
    got = sorted((r.ticker, r.date.day, r.open, r.adj_close) for r in readers.vendor_prices(spark, str(tmp_path / "w"), ev).collect())
    assert got == [("0050", 6, 10.0, 18.0), ("0050", 7, None, 20.0), ("1101", 6, 1.0, 2.0)]
    put(tmp_path / "r/1.json", {"data": [{"date": "2024-05-10", "stock_id": "1", "revenue": 5.0, "revenue_month": 4, "revenue_year": 2024}]})
    r = readers.month_revenue(spark, str(tmp_path / "r")).first()
    assert (r.month, r.announce_date, r.revenue_yoy) == (D("2024-04-01"), D("2024-05-10"), None)
    raw = spark.createDataFrame([("1", "113/05/06", "100.0", "1,90.5"), ("1", "x", "-", "0")], "ticker string, d string, b string, a string")
    e = readers.event_rows(raw, F.col("d"), F.col("b"), F.col("a"), "exright").collect()
    assert e[0].date == D("2024-05-06") and e[0].factor == pytest.approx(1.905) and e[1].factor is None


def test_news_only_completed_windows(spark, tmp_path):
    item = lambda i, t="t": {"newsId": i, "publishAt": 1715000000 if i else None, "title": t, "content": "<b>&amp;x</b>"}
    put(tmp_path / "w1/p1.json", {"items": {"data": [item(1), item(1), item(0)]}})
    put(tmp_path / "w1/_complete.json", {})
    put(tmp_path / "w2/p1.json", {"items": {"data": [item(2)]}})
    assert [(r.news_id, r.content) for r in readers.news(spark, str(tmp_path)).collect()] == [(1, "&x")]


def test_digests_and_sinks(spark, tmp_path):
    put(tmp_path / "f/a.txt", "a")
    put(tmp_path / "f/b.txt", "b")
    one, two = (hashlib.sha256(x).digest() for x in (b"a", b"b"))
    r = readers.batch_digest(readers.file_digests(spark, str(tmp_path / "f")), F.lit("all")).first()
    assert (r.n_files, r.sha256) == (2, hashlib.sha256(one + two).hexdigest())
    d = spark.createDataFrame([(1, 0.5, None)], "a int, b double, c string")
    sinks.parquet(d, str(tmp_path / "o"), ["a"])
    sinks.report_csv(d, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1 and spark.read.csv(str(tmp_path / "c"), header=True).count() == 1
    assert sinks.markdown(d).splitlines()[-1] == "| 1 | 0.5000 |  |"


def test_batteries(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame([(i, D("2020-01-05") + dt.timedelta(7 * t)) for i in range(12) for t in range(30)], columns=["ticker", "week"])
    n = len(pdf)
    pdf = pdf.assign(abn_attention_weekend=rng.normal(size=n), abn_attention_weekday=rng.normal(size=n), ret_lag1=rng.normal(size=n), sparsity_tier=np.where(pdf.ticker < 6, "dense", "sparse"), att_nonzero_weeks_52=np.where(pdf.ticker < 6, 45, 20), att_all=rng.integers(0, 9, n), turnover=rng.random(n), ret=rng.normal(size=n), moderator=rng.normal(size=n))
    pdf["ret_next"] = 0.5 * pdf.abn_attention_weekend + 0.1 * rng.normal(size=n)
    d = spark.createDataFrame(pdf).cache()
    kw = {"controls": ("ret_lag1", "absent"), "gates": (50, 5, 10)}
    fits = {f.name: f for f in specs.run(d, specs.main(), **kw)}
    assert fits["weekend"].status == "OK" and fits["weekend"].t(specs.WEEKEND) > 5 and "absent" in fits["weekend"].note
    assert fits["session"].status == "SKIPPED" and specs.run(d, specs.main(), diagnostic=False, **kw)[1].status == "SKIPPED"
    assert [f.status for f in specs.interactions(d, ["moderator", "none"], **kw)] == ["OK", "SKIPPED"]
    assert len(specs.terciles(d, "moderator", **kw)) == 3
    grid = specs.robustness(d, dense_grid=(40,), **kw)
    assert {f.status for f in grid} == {"OK", "SKIPPED"} and specs.summary(spark, grid).count() == len(grid)
    two, one = specs.inference_sensitivity(d, "ret_next", (specs.WEEKEND,), **kw)
    assert two.params == pytest.approx(one.params)
    assert specs.comovement(d).count() == 12
    f = specs.event_feasibility(d.withColumn("flag", F.col("week") < F.lit("2020-02-01").cast("date")), "flag")
    assert f["n_usable_weeks"] == 4 and f["verdict"] == "exploratory"
    c = spark.createDataFrame([("a", True, 0.5, 0.1, 0.25, 0.1), ("b", True, 0.01, 0.1, 0.5, 0.1), ("c", False, 0.5, 0.1, 0.5, 0.1)], "item string, comparable boolean, published double, published_se double, ours double, ours_se double")
    assert [r.ratio for r in specs.comparison(c).orderBy("item").collect()] == [0.5, None, None]
