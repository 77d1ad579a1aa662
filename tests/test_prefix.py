"""Walk-forward by cumulative sums against a plain refit at every cut-off."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import models, prefix

COLS, ALPHAS = ["a", "b", "late", "flag"], (0.1, 1.0, 10.0, 100.0)


def frame(seed=1, n_weeks=70, n_names=40):
    rng = np.random.default_rng(seed)
    rows = [(i, dt.date(2020, 1, 6) + dt.timedelta(7 * t)) for t in range(n_weeks) for i in range(n_names)]
    p = pd.DataFrame(rows, columns=["ticker", "as_of"])
    n = len(p)
    p["label_end_at"] = [d + dt.timedelta(int(k)) for d, k in zip(p.as_of, rng.integers(4, 12, n))]
    p["label_available_at"] = [d + dt.timedelta(1) for d in p.label_end_at]
    p["label_status"] = np.where(rng.random(n) < 0.95, "ok", "label_missing")
    p["a"], p["b"] = rng.normal(size=n), rng.normal(3, 2, n).round(1)
    p.loc[rng.random(n) < 0.2, "b"] = np.nan
    p["late"] = np.where(p.as_of > dt.date(2020, 9, 1), rng.normal(size=n) * 100, np.nan)
    p["flag"] = (rng.random(n) < 0.3).astype(float)
    p["y"] = 0.3 * p.a + 0.1 * p.b.fillna(0) + rng.normal(size=n)
    p.loc[rng.random(n) < 0.05, "y"] = np.nan
    return p


def rows_of(spark, p):
    """Missing values as nulls."""
    kind = {"ticker": "long", "label_status": "string"} | dict.fromkeys(("as_of", "label_end_at", "label_available_at"), "date")
    return spark.createDataFrame(p.astype(object).where(p.notna(), None), ", ".join(f"{c} {kind.get(c, 'double')}" for c in p.columns))


def mature(p, cut):
    return p[(p.label_end_at < cut) & (p.label_available_at < cut) & (p.label_status == "ok") & p.y.notna() & (p.as_of < cut)]


def design(train, rows, cols):
    kept = [c for c in cols if train[c].notna().any()]
    flagged = [c for c in kept if train[c].isna().any()]
    build = lambda f: np.column_stack([*[f[c].fillna(train[c].median()) for c in kept], *[f[c].isna().astype(float) for c in flagged]])
    x, out = build(train), build(rows)
    c, s = x.mean(axis=0), x.std(axis=0)
    s = np.where(s > 1e-12, s, 1.0)
    return (x - c) / s, (out - c) / s


def ridge(train, rows, cols, alpha):
    z, out = design(train, rows, cols)
    e = train.y.to_numpy() - train.y.mean()
    return train.y.mean() + out @ np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ e)


def best_alpha(p, cut, cols, size, least_weeks, least):
    own = mature(p, cut)
    weeks, scores = sorted(own.as_of.unique()), {a: [] for a in ALPHAS}
    for b in (3, 2, 1):
        start = len(weeks) - b * size
        if start < least_weeks:
            continue
        train, valid = mature(p, weeks[start]), own[own.as_of.isin(weeks[start : start + size])]
        if len(train) < 100:
            continue
        for a in ALPHAS:
            v = valid.assign(pred=ridge(train, valid, cols, a))
            ic = [np.corrcoef(g.pred.rank(), g.y.rank())[0, 1] for _, g in v.groupby("as_of") if len(g) >= least]
            if len(ic) >= 5:
                scores[a].append(np.mean(ic))
    means = {a: round(np.mean(s), 12) for a, s in scores.items() if s}
    return max(means, key=lambda a: (means[a], a)) if means else max(ALPHAS)


@pytest.mark.parametrize("alpha", [10.0, None])
def test_walk_forward_equals_plain_refits(spark, alpha):
    p = frame()
    refits = [dt.date(2020, 3, 2), dt.date(2020, 9, 7), dt.date(2020, 12, 7), dt.date(2021, 3, 1)]
    sets = {"A": COLS[:2], "B": COLS}
    d = rows_of(spark, p).repartition(5)
    out = models.walk_forward(d, COLS, "y", refits, alpha, sets=sets, **({"size": 8, "least_weeks": 12} if alpha is None else {}))
    got = {(r.feature_set, r.ticker, r.as_of): (r.pred, r.refit_at, r.alpha) for r in out.collect()}
    want = {}
    for i, cut in enumerate(refits):
        stop = refits[i + 1] if i + 1 < len(refits) else dt.date(9999, 1, 1)
        train, rows = mature(p, cut), p[(p.as_of >= cut) & (p.as_of < stop)]
        for name, cols in sets.items():
            a = alpha if alpha else best_alpha(p, cut, cols, 8, 12, 30)
            for t, w, v in zip(rows.ticker, rows.as_of, ridge(train, rows, cols, a)):
                want[name, t, w] = (v, cut, a)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k][1:] == v[1:] and got[k][0] == pytest.approx(v[0], abs=1e-8)
    if alpha is None:
        assert len({a for _, _, a in want.values()}) > 1


def test_jobs_do_not_grow_with_refits(spark):
    d = spark.createDataFrame(frame().drop(columns=["late"]).fillna({"y": 0.0, "b": 0.0})).cache()
    d.count()
    weeks = [dt.date(2020, 6, 1) + dt.timedelta(14 * k) for k in range(20)]

    def jobs(group, refits):
        spark.sparkContext.setJobGroup(group, group)
        models.walk_forward(d, ["a", "b"], "y", refits, 1.0).count()
        spark.sparkContext.setJobGroup("rest", "rest")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs("many refits", weeks) <= jobs("two refits", weeks[:2]) + 4


def test_medians_of_growing_samples_are_exact(spark):
    p = frame(3)
    p["b"] = np.where(p.b > 3, 7.0, p.b)  # one value of half the rows
    d = rows_of(spark, p.drop(columns="flag")).repartition(4)
    cuts = [dt.date(2020, 2, 1) + dt.timedelta(30 * k) for k in range(12)]
    sums = prefix.Prefix(d, ["a", "b", "late"], "y", cuts)
    for i, cut in enumerate(cuts):
        own = mature(p, cut)
        assert sums.count(cut) == len(own)
        for j, c in enumerate(("a", "b", "late")):
            want = own[c].median()
            assert (np.isnan(sums.medians[i, j]) and np.isnan(want)) or sums.medians[i, j] == pytest.approx(want, abs=1e-12)


def test_no_rows(spark):
    d = spark.createDataFrame(frame().drop(columns=["late"])).where("false")
    assert models.walk_forward(d, ["a"], "y", [dt.date(2020, 6, 1)]).count() == 0
    assert models.select_alpha(d, ["a"], "y") == 100.0
