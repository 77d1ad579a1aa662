"""Walk-forward logistic regressions against plain fits, one at a time."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import classify

from .test_prefix import design, frame, mature, rows_of

COLS, CS = ["a", "b", "late"], (0.01, 0.1, 1.0, 10.0)


def newton(z, y, c):
    x = np.column_stack([np.ones(len(z)), z])
    pen, w = np.r_[0.0, np.ones(z.shape[1])] / c, np.zeros(z.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        d = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(pen), x.T @ (p - y) + pen * w)
        w = w - d
        if np.abs(d).max() < 1e-12:
            break
    return w


def prob(train, rows, cols, c):
    z, out = design(train, rows, cols)
    w = newton(z, train.y.to_numpy(float), c)
    return 1 / (1 + np.exp(-(w[0] + out @ w[1:])))


def data():
    p = frame(2)
    p["y"] = np.where(p.y.isna(), np.nan, (p.y > 0.3).astype(float))
    return p


def test_equals_plain_fits(spark):
    p = data()
    refits = [dt.date(2020, 3, 2), dt.date(2020, 10, 5), dt.date(2021, 3, 1)]
    out = classify.walk_forward(rows_of(spark, p).repartition(5), "y", refits, {"A": COLS[:2], "B": COLS}, CS, size=8, least_weeks=12)
    got = {(r.feature_set, r.ticker, r.as_of): r for r in out.collect()}
    n = 0
    for i, cut in enumerate(refits):
        train = mature(p, cut)
        rows = p[(p.as_of >= cut) & (p.as_of < (refits[i + 1] if i < 2 else dt.date(9999, 1, 1)))]
        weeks = sorted(train.as_of.unique())
        blocks = [(weeks[len(weeks) - b * 8], weeks[len(weeks) - b * 8 : len(weeks) - b * 8 + 8]) for b in (3, 2, 1) if len(weeks) - b * 8 >= 12]
        if not blocks:
            start = weeks[-min(8, len(weeks) // 4)]
            blocks = [(start, [w for w in weeks if w >= start])]
        for name, cols in (("A", COLS[:2]), ("B", COLS)):
            scores, oof = {c: [] for c in CS}, {c: [] for c in CS}
            for before, own in blocks:
                tr, va = mature(p, before), train[train.as_of.isin(own)]
                if len(tr) < 100 or len(va) < 50:
                    continue
                for c in CS:
                    q = prob(tr, va, cols, c)
                    scores[c].append(np.mean((q - va.y) ** 2))
                    oof[c].append((q, va.y.to_numpy()))
            usable = {c: round(np.mean(s), 12) for c, s in scores.items() if s}
            c = min(usable, key=lambda c: (usable[c], c)) if usable else CS[2]
            cal = None
            if usable:
                q, t = (np.concatenate(x) for x in zip(*oof[c]))
                cal = newton(q[:, None], t, np.inf) if len(q) >= 100 else None
            for t, w, v in zip(rows.ticker, rows.as_of, prob(train, rows, cols, c)):
                r = got[name, t, w]
                n += 1
                assert (r.refit_at, r.c) == (cut, c) and r.prob == pytest.approx(v, abs=1e-7)
                if cal is None:
                    assert r.prob_calibrated is None
                else:
                    assert r.prob_calibrated == pytest.approx(1 / (1 + np.exp(-(cal[0] + cal[1] * v))), abs=1e-5)
    assert n == len(got)


def test_one_class_and_no_rows(spark):
    d = rows_of(spark, data())
    assert classify.walk_forward(d.withColumn("y", F.lit(1.0)), "y", [dt.date(2020, 6, 1)], {"A": ["a"]}, size=8, least_weeks=12).count() == 0
    assert classify.walk_forward(d.where("false"), "y", [dt.date(2020, 6, 1)], {"A": ["a"]}).count() == 0


def test_sums_of_a_batch_are_shared_by_its_models():
    """Equal to one model after the other, in less than half of the time."""
    import time

    r = np.random.default_rng(8)
    u = np.column_stack([np.ones(10_000), r.normal(size=(10_000, 8))])
    y, gap = (r.random(10_000) < 0.4).astype(float), r.integers(0, 15, 10_000)
    coef, gaps = r.normal(size=(120, 9)), np.repeat(np.arange(15), 8)

    def plain():
        out = []
        for c, g in zip(coef, gaps):
            v, t = u[gap <= g], y[gap <= g]
            eta = v @ c
            p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
            out.append((v.T @ (p - t), (v * (p * (1 - p))[:, None]).T @ v, [(np.logaddexp(0.0, eta) - t * eta).sum()]))
        return [np.array(a) for a in zip(*out)]

    def timed(f):
        best = []
        for _ in range(3):
            start = time.process_time()
            out = f()
            best.append(time.process_time() - start)
        return out, min(best)

    want, slow = timed(plain)
    got, fast = timed(lambda: classify.batch_sums(u, y, gap, coef, gaps))
    for a, b in zip(got, want):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-8)
    print("seconds", slow, fast)
    assert fast < slow / 2
