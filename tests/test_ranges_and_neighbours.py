"""Range aggregates by dyadic blocks and exact nearest matching, against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import asof, research

DAY = dt.date(2024, 1, 1)


def test_range_aggregate(spark):
    rng = np.random.default_rng(1)
    rows = [(k, DAY + dt.timedelta(int(x)), float(v) if rng.random() > 0.1 else None) for k, n in (("a", 400), ("b", 3), ("c", 65)) for x, v in zip(rng.integers(0, 600, n), rng.normal(size=n))]  # days repeat
    spans = [(k, DAY + dt.timedelta(int(a)), DAY + dt.timedelta(int(a + n))) for k in "abcd" for a, n in zip(rng.integers(-20, 620, 60), rng.integers(-3, 400, 60))] + [("a", None, DAY), ("a", DAY, None)]
    d, r = spark.createDataFrame(rows, "k string, date date, v double"), spark.createDataFrame(spans, "k string, s date, e date")
    got = {(q.k, q.s, q.e): (q.n, q.total, q.least, q.most) for q in asof.range_aggregate(r, d, "k", "s", "e", "v").collect()}
    assert set(got) == set(spans)
    for k, a, b in spans:
        own = [v for q, x, v in rows if q == k and a is not None and b is not None and a <= x <= b]
        some = [v for v in own if v is not None]
        n, total, least, most = got[k, a, b]
        assert n == len(own) and (least, most) == ((min(some), max(some)) if some else (None, None))
        assert total == pytest.approx(sum(some)) if some else total is None


def events(spark, rng, blocks, names, treated, clusters):
    rows = []
    for w in range(blocks):
        centre = rng.normal(scale=5, size=(clusters, 13))
        for i in range(names):
            path = (centre[rng.integers(clusters)] + rng.normal(scale=0.05, size=13)).round(3)
            rows.append((f"t{i}", DAY + dt.timedelta(7 * w), "dense", i < treated, [float(v) for v in path], float(path[:3].sum()), float(rng.normal())))
    rows += [(f"u{j}", rows[0][1], *rows[0][2:3], False, *rows[0][4:]) for j in range(5)]  # equal distances
    return spark.createDataFrame(rows, "ticker string, week date, sparsity_tier string, event boolean, path array<double>, log_mktcap double, log_turnover double")


@pytest.mark.parametrize("k,names", [(1, 300), (3, 300), (2, 6)])
def test_nearest_without_a_caliper(spark, k, names):
    d = events(spark, np.random.default_rng(2), 3, names, 3, 12)
    cands = research.candidates(d, "event")
    got = {}
    for r in research.match_pairs(cands, k=k, caliper=None).collect():
        got.setdefault((r.week, r.t_ticker), []).append((r["rank"], r.c_ticker))
    p, want = cands.toPandas(), {}
    for week, g in p.groupby("week"):
        x = g[list(research.MATCH_VARS)].to_numpy()
        z = np.nan_to_num((x - x.mean(axis=0)) / x.std(axis=0, ddof=1))
        own = np.flatnonzero(~g.treated.to_numpy())
        for a in np.flatnonzero(g.treated.to_numpy()) if len(own) >= k else ():
            near = sorted((round(float(np.sqrt(((z[a] - z[b]) ** 2).sum())), 9), g.ticker.iloc[b]) for b in own)[:k]
            want[week, g.ticker.iloc[a]] = [(i, c) for i, (_, c) in enumerate(near, 1)]
    assert {key: sorted(v) for key, v in got.items()} == want


def test_few_pairs_are_met_on_clustered_data(spark):
    d = events(spark, np.random.default_rng(3), 1, 2500, 40, 30)
    c = research.candidates(d, "event").select("week", "sparsity_tier", "ticker", "treated", *[F.col(v).alias(f"z{i}") for i, v in enumerate(research.MATCH_VARS)])
    side = lambda cond, s: c.where(cond).select("week", "sparsity_tier", *[F.col(x).alias(f"{s}_{x}") for x in ("ticker", *[f"z{i}" for i in range(5)])])
    met = research.nearest_pairs(side("treated", "t"), side("NOT treated", "c"), ["week", "sparsity_tier"], [f"z{i}" for i in range(5)], 1).count()
    assert met < 0.05 * 40 * 2465


def test_rows_of_one_place_ask_once(spark):
    """Copies of names neither multiply the pairs nor change who is nearest."""
    rng, copies = np.random.default_rng(4), 40
    rows = [(0, "dense", 1000 * j + i, i < 20, *map(float, x)) for i, x in enumerate(rng.normal(size=(100, 3))) for j in range(copies)]
    d = spark.createDataFrame(rows, "week int, sparsity_tier string, ticker int, treated boolean, z0 double, z1 double, z2 double")
    side = lambda cond, s: d.where(cond).select("week", "sparsity_tier", *[F.col(x).alias(f"{s}_{x}") for x in ("ticker", "z0", "z1", "z2")])
    got = {}
    for r in research.nearest_pairs(side("treated", "t"), side("NOT treated", "c"), ["week", "sparsity_tier"], ["z0", "z1", "z2"], 3).collect():
        got.setdefault(r.t_ticker, set()).add(r.c_ticker)
    z = {r[2]: np.array(r[4:]) for r in rows if r[2] < 1000}
    for i in range(20):
        near = min(range(20, 100), key=lambda b: ((z[i] - z[b]) ** 2).sum())
        assert all(got[1000 * j + i] == {near, 1000 + near, 2000 + near} for j in range(copies))


def test_returns_of_a_week_without_a_window(spark):
    rows = spark.createDataFrame([("a", DAY, 1.0), ("b", DAY, 3.0), ("c", DAY, None), ("a", None, 5.0), ("b", None, 6.0)], "ticker string, week date, ret double")
    out = research.abnormal_returns(rows)
    assert sorted(((r.ticker, r.week, r.ar) for r in out.collect()), key=str) == [("a", None, -0.5), ("a", DAY, -1.0), ("b", None, 0.5), ("b", DAY, 1.0), ("c", DAY, None)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
