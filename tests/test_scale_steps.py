"""Steps whose cost must not grow faster than the table: grids, moments of tiers, ranges, the prospective loop, bulk flags."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.operators import asof, backtest, panel, prospective, research

D = dt.date.fromisoformat


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_weeks_are_filled_without_a_join(spark):
    rows = spark.createDataFrame([("a", D("2024-01-14"), 2, 1.5), ("a", D("2024-01-28"), None, 2.5), ("b", None, 7, 7.5), ("b", D("2024-01-07"), 3, 3.5), ("c", None, 4, 4.5), (None, D("2024-01-21"), 5, 5.5)], "k string, week date, n int, v double")
    out = panel.fill_weeks(rows, "k", F.lit(D("2024-01-07")), F.lit(D("2024-02-04")), ["n"])
    got = {(r.k, r.week): (r.n, r.v) for r in out.collect()}
    weeks = [D("2024-01-07") + dt.timedelta(7 * i) for i in range(5)]
    assert out.count() == len(got) == 20 and set(got) == {(k, w) for k in ("a", "b", "c", None) for w in weeks}
    there = {("a", weeks[1]): (2, 1.5), ("a", weeks[3]): (0, 2.5), ("b", weeks[0]): (3, 3.5)}
    assert all(got[c] == there.get(c, (0, None)) for c in got)
    assert "Join" not in plan(out)


def test_tiers_are_standardised_without_a_window(spark):
    rows = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("x", None), ("y", 5.0), (None, 1.0)], "g string, v double")
    out = research.standardise(rows, ["v"], ["g"])
    assert out.columns == ["g", "v", "z_v"]
    got = sorted(((r.g, r.v, r.z_v) for r in out.collect()), key=str)
    assert got == [("x", 1.0, pytest.approx(-(0.5**0.5))), ("x", 3.0, pytest.approx(0.5**0.5)), ("x", None, None), ("y", 5.0, None)]
    assert "Window" not in plan(out)


def test_ranges_of_several_values(spark):
    days = spark.createDataFrame([("a", D(f"2024-01-{i:02d}"), float(i), float(-i)) for i in range(1, 21)], "k string, date date, u double, v double")
    spans = spark.createDataFrame([("a", D("2024-01-03"), D("2024-01-09")), ("a", D("2024-02-03"), D("2024-02-09"))], "k string, s date, e date")
    got = {r.s: r.asDict() for r in asof.range_aggregates(spans, days, "k", "s", "e", ["u", "v"]).collect()}
    one, none = got[D("2024-01-03")], got[D("2024-02-03")]
    assert (one["n"], one["total_u"], one["least_u"], one["most_u"], one["total_v"], one["least_v"], one["most_v"]) == (7, 42.0, 3.0, 9.0, -42.0, -9.0, -3.0)
    assert none["n"] == 0 and none["total_u"] is None


def test_the_loop_joins_once(spark, tmp_path, monkeypatch):
    kept = []
    cut = prospective.cut_lineage
    monkeypatch.setattr(prospective, "cut_lineage", lambda df: kept.append(df) or cut(df))
    weeks = [D("2024-01-01") + dt.timedelta(7 * i) for i in range(12)]
    feats = spark.createDataFrame([(f"t{i}", w, "dense", float(i * j % 7)) for i in range(8) for j, w in enumerate(weeks)], "ticker string, as_of date, sparsity_tier string, x double")
    labels = spark.createDataFrame([(f"t{i}", w, w + dt.timedelta(5), w + dt.timedelta(6), "ok", float(i - j)) for i in range(8) for j, w in enumerate(weeks)], "ticker string, as_of date, label_end_at date, label_available_at date, label_status string, y_excess double")
    loop = prospective.Loop(str(tmp_path / "loop"), {"A": ["x"]}, least_names=5, alpha=1.0)
    assert [r["status"] for r in prospective.backfill(spark, feats, labels, 3, loop)] == ["predicted"] * 3
    assert len(kept) == 1


def test_entities_of_an_article_without_a_join(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, None), (2, "a"), (3, None), (None, "a")], "article long, k string")
    out = panel.bulk_flag(rows, "article", "k", 1)
    assert sorted({(r.article, r.n_entities, r.is_bulk) for r in out.collect()}) == [(1, 2, True), (2, 1, False), (3, 0, False)] and out.count() == 6
    assert "Join" not in plan(out)


def test_candidates_look_at_the_days_of_their_names_only(spark):
    day = D("2024-01-01")
    pred = spark.createDataFrame([("a", day, 2.0), ("b", day, 1.0)], "ticker string, as_of date, p double")
    labels = spark.createDataFrame([(k, day, D("2024-01-02"), D("2024-01-05"), "ok") for k in "ab"], "ticker string, as_of date, entry_at date, label_end_at date, label_status string")
    daily = spark.createDataFrame([(k, D(f"2024-01-{i:02d}"), 10.0 + i, 11.0 + i, 5.0) for k in "abc" for i in range(1, 8)], "ticker string, date date, adj_open double, adj_close double, value double")
    out = backtest.candidates(pred, labels, daily, "p", top_k=1)
    assert [(r.ticker, r["rank"], r.px_in, r.px_out) for r in out.collect()] == [("a", 1, 12.0, 16.0)]
    assert "LeftSemi" in plan(out)
