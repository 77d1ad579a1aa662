"""Histogram boosting against a plain version that splits one leaf at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boosting as B
from panelforge.operators import models


def plain_tree(codes, grad, max_leaves, least, l2, rate):
    """Best-first by full rescans: every split looks at every leaf, feature, bin and side of the missing."""
    leaves, value = {0: np.arange(len(grad))}, {}
    order = 1

    def best(rows):
        g, n, top = grad[rows].sum(), len(rows), (1e-12 * max(1.0, grad[rows].sum() ** 2 / (len(rows) + l2)), None)
        for side in (False, True):
            for f in range(codes.shape[1]):
                c = codes[rows, f]
                if side and not (c == B.BINS).any():
                    continue
                for b in range(B.BINS - 1):
                    left = (c <= b) | ((c == B.BINS) & side)
                    nl = left.sum()
                    if nl < least or n - nl < least:
                        continue
                    gl = grad[rows[left]].sum()
                    gain = gl**2 / (nl + l2) + (g - gl) ** 2 / (n - nl + l2) - g**2 / (n + l2)
                    if gain > top[0] * (1 + 1e-9):
                        top = (gain, left)
        return top

    known = {}
    while len(leaves) < max_leaves:
        for k in leaves:
            if k not in known:
                known[k] = best(leaves[k])
        k = max(leaves, key=lambda k: (known[k][0] if known[k][1] is not None else -1, -k))
        if known[k][1] is None:
            break
        rows, left = leaves.pop(k), known[k][1]
        leaves[order], leaves[order + 1] = rows[left], rows[~left]
        order += 2
    out = np.zeros(len(grad))
    for rows in leaves.values():
        out[rows] = -rate * grad[rows].sum() / (len(rows) + l2)
    return out, len(leaves)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"a": rng.normal(size=900), "b": rng.integers(0, 6, 900).astype(float), "c": rng.normal(size=900)})
    p["y"] = np.sin(2 * p.a) + (p.b > 3) * p.c + rng.normal(size=900) * 0.2
    p.loc[rng.random(900) < 0.2, "c"] = np.nan
    p["id"] = np.arange(900)
    return p


def frame(spark, p):
    return spark.createDataFrame(p.astype(object).where(p.notna(), None), "a double, b double, c double, y double, id long").repartition(4)


def test_equals_plain_boosting(spark, data, monkeypatch):
    monkeypatch.setattr(B, "REFRESH", 3)
    d = frame(spark, data)
    m = B.fit(d, ["a", "b", "c"], "y", iterations=5, rate=0.3, max_leaves=6, least_leaf=20, l2=1.0)
    codes = B.encode(data[["a", "b", "c"]].to_numpy(float), m.edges)
    want = np.full(len(data), data.y.mean())
    for t in m.trees:
        own, n = plain_tree(codes, want - data.y.to_numpy(), 6, 20, 1.0, 0.3)
        assert sum(f < 0 for f in t.feature) == n == 6
        want += own
    got = m.predict(d, ["id"]).toPandas().set_index("id").pred.sort_index()
    assert got.to_numpy() == pytest.approx(want, abs=1e-9)
    assert np.var(data.y - want) < 0.5 * np.var(data.y)


def test_trees_are_rows(spark, data):
    m = B.fit(frame(spark, data), ["a", "b"], "y", iterations=2, max_leaves=3, least_leaf=50)
    t = m.table(spark).toPandas()
    assert t.groupby("tree").feature.count().tolist() == [2, 2] and t[t.feature.isna()].value.notna().all()
    # The root's rule read from the rows splits as the model does.
    root = t[(t.tree == 0) & (t.node == 0)].iloc[0]
    left = data[root.feature] <= root.upto
    ends = m.trees[0].leaves(B.encode(data[["a", "b"]].to_numpy(float), m.edges))
    below = {root.left}
    for node in (m.trees[0].left[root.left], m.trees[0].right[root.left]):
        below.add(node)
    assert (left.to_numpy() == np.isin(ends, list(below))).all()


def test_few_passes_a_tree(data):
    codes = B.encode(data[["a", "b", "c"]].to_numpy(float), [np.quantile(data[c].dropna(), np.linspace(0.05, 0.95, 19)) for c in "abc"])
    grad, calls = data.y.to_numpy() - data.y.mean(), []

    def sums(tree, nodes):
        calls.append(len(nodes))
        return B.histograms(codes, grad, tree.leaves(codes), nodes)

    tree = B.grow(sums, 15, 10, 1.0, 0.1)
    assert sum(f < 0 for f in tree.feature) == 15 and len(calls) < 14


def test_degenerate_inputs(spark, data):
    d = frame(spark, data)
    assert B.fit(d.where("false"), ["a"], "y", iterations=2).trees == []
    m = B.fit(d.withColumn("a", F.lit(None).cast("double")), ["a"], "y", iterations=1)
    assert m.predict(d, ["id"]).first().pred == pytest.approx(data.y.mean(), abs=1e-9)
    few = B.fit(d.limit(30), ["a"], "y", iterations=1, least_leaf=100)
    assert len(few.trees[0].value) == 1


def test_behind_medians_and_indicators(spark, data):
    d = frame(spark, data)
    fitted = models.boosted_trees(d, ["a", "c"], "y", iterations=3, rate=0.3, max_leaves=5, least_leaf=20)
    assert fitted[0].indicators == ["c"] and fitted[1].features == ["z_a", "z_c", "z_miss_c"]
    got = models.predict_boosted(fitted, d, ["id", "y"]).toPandas()
    assert len(got) == 900 and np.var(got.y - got.pred) < 0.8 * np.var(got.y)
