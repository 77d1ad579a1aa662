"""Gradient boosting on histograms: squared loss, best-first trees, from distributed sums.

Columns are cut into at most ``BINS`` bins once; a row is then an array of small codes.  A tree
grows best-first to ``max_leaves``: the leaf whose best split gains most is split next.  To pick
a split one needs the sums of gradients by (leaf, feature, bin); one pass collects them for the
children of all leaves that could be split next, so a tree costs about as many passes as it
is deep.  What travels are these sums, whose size does not depend on the rows.  Missing values
are a bin of their own and go to the side that gains more (the larger one, if a leaf has none).

Trees are rows (``Boosted.table``), and the running prediction is written out every ``REFRESH``
trees, so that a pass evaluates few trees and a lost executor repeats little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows as W
from ..session import cut_lineage

BINS, REFRESH = 255, 10


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1.  Codes up to ``bin`` go left."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, v in (("feature", -1), ("bin", 0), ("missing_left", False), ("left", -1), ("right", -1), ("value", value)):
            getattr(self, name).append(v)
        return len(self.value) - 1

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node where each row ends."""
        at = np.zeros(len(codes), dtype=np.int64)
        f, b, m, le, ri = (np.array(x) for x in (self.feature, self.bin, self.missing_left, self.left, self.right))
        rows = np.arange(len(codes))
        while (inner := f[at] >= 0).any():
            own = at[inner]
            code = codes[rows[inner], f[own]]
            at[inner] = np.where(np.where(code == BINS, m[own], code <= b[own]), le[own], ri[own])
        return at

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(codes)]


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: tuple[float, int]  # gradient and rows
    right: tuple[float, int]


def best_split(g: np.ndarray, n: np.ndarray, least: int, l2: float) -> Split | None:
    """The split of most gain from sums by (feature, bin), the last bin being the missing one; ties: the first."""
    total_g, total_n = g[0].sum(), n[0].sum()
    if total_n < 2 * least:
        return None
    own = total_g**2 / (total_n + l2)
    best, found = 1e-12 * max(1.0, own), None
    for missing_left in (False, True):
        lg = np.cumsum(g[:, :-1], axis=1)[:, :-1] + (g[:, -1:] if missing_left else 0.0)
        ln = np.cumsum(n[:, :-1], axis=1)[:, :-1] + (n[:, -1:] if missing_left else 0)
        rg, rn = total_g - lg, total_n - ln
        ok = (ln >= least) & (rn >= least)
        if missing_left:
            ok &= n[:, -1:] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, lg**2 / (ln + l2) + rg**2 / (rn + l2) - own, -np.inf)
        at = int(np.argmax(gain))
        f, b = divmod(at, gain.shape[1])
        if gain[f, b] > best:
            best = float(gain[f, b])
            side = missing_left if n[f, -1] else bool(ln[f, b] > rn[f, b])
            found = Split(best, f, b, side, (float(lg[f, b]), int(ln[f, b])), (float(rg[f, b]), int(rn[f, b])))
    return found


def histograms(codes: np.ndarray, grad: np.ndarray, node: np.ndarray, wanted: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient sums and row counts by (wanted node, feature, bin)."""
    k, width = codes.shape[1], BINS + 1
    place = np.full(int(max(node.max(initial=0), max(wanted))) + 1, -1)
    place[wanted] = np.arange(len(wanted))
    own = place[node]
    keep = own >= 0
    cell = ((own[keep, None] * k + np.arange(k)) * width + codes[keep]).ravel()
    size = len(wanted) * k * width
    g = np.bincount(cell, weights=np.repeat(grad[keep], k), minlength=size)
    return g.reshape(len(wanted), k, width), np.bincount(cell, minlength=size).reshape(len(wanted), k, width)


def grow(sums, max_leaves: int, least: int, l2: float, rate: float) -> Tree:
    """A tree from ``sums(tree, nodes)``, which gives histograms of nodes of a (partly tentative) tree.

    Every leaf that could be split has its children in the tree already, tentatively, so that one
    call serves the whole frontier; children that are not taken are cut off at the end.
    """
    tree, splits = Tree(), {}
    value = lambda g, n: -rate * g / (n + l2)

    def look(nodes: list[int]) -> None:
        g, n = sums(tree, nodes)
        for i, node in enumerate(nodes):
            s = best_split(g[i], n[i], least, l2)
            splits[node] = s
            if node == 0:
                tree.value[0] = value(g[i][0].sum(), n[i][0].sum())
            if s is not None:
                tree.feature[node], tree.bin[node], tree.missing_left[node] = s.feature, s.bin, s.missing_left
                tree.left[node], tree.right[node] = tree.add(value(*s.left)), tree.add(value(*s.right))

    tree.add(0.0)
    look([0])
    leaves = [0]
    while len(leaves) < max_leaves:
        unknown = [c for x in leaves if splits.get(x) for c in (tree.left[x], tree.right[x]) if c not in splits]
        open_ = [x for x in leaves if splits.get(x)]
        if not open_:
            break
        take = max(open_, key=lambda x: (splits[x].gain, -x))
        if tree.left[take] in unknown and len(leaves) + 1 < max_leaves:
            look(unknown)
        leaves.remove(take)
        leaves += [tree.left[take], tree.right[take]]
        for c in leaves[-2:]:
            splits.setdefault(c, None)
    return _pruned(tree, set(leaves))


def _pruned(tree: Tree, leaves: set[int]) -> Tree:
    out = Tree()

    def copy(x: int) -> int:
        at = out.add(tree.value[x])
        if x not in leaves:
            out.feature[at], out.bin[at], out.missing_left[at] = tree.feature[x], tree.bin[x], tree.missing_left[x]
            out.left[at] = copy(tree.left[x])
            out.right[at] = copy(tree.right[x])
        return at

    copy(0)
    return out


def encode(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin codes of a matrix; NaN is ``BINS``."""
    cols = [np.where(np.isnan(x[:, j]), BINS, np.searchsorted(e, x[:, j])) for j, e in enumerate(edges)]
    return np.column_stack(cols).astype(np.int64) if cols else np.zeros((len(x), 0), dtype=np.int64)


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        """tree, node, feature, upto (largest value that goes left), missing_left, left, right, value."""
        rows = [(t, i, self.features[x.feature[i]] if x.feature[i] >= 0 else None, float(self.edges[x.feature[i]][x.bin[i]]) if x.feature[i] >= 0 else None, x.missing_left[i], x.left[i], x.right[i], float(x.value[i])) for t, x in enumerate(self.trees) for i in range(len(x.value))]
        return spark.createDataFrame(rows, "tree int, node int, feature string, upto double, missing_left boolean, left int, right int, value double")

    def predict(self, df: DataFrame, keep: list[str], out: str = "pred") -> DataFrame:
        """``keep`` and the prediction."""
        edges, base, trees, width = self.edges, self.base, self.trees, len(self.features)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = encode(_matrix(batch, "__x", width).astype(float), edges)
                pred = base + sum((t.predict(codes) for t in trees), np.zeros(len(codes)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred)], [*keep, out])

        rows = df.select(*keep, _values(self.features).alias("__x"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
        return rows.mapInArrow(score, f"{schema}, {out} double")


def _values(features: list[str]):
    return F.array(*[W.finite(F.col(c).cast("double")) for c in features]).cast("array<double>")


def fit(train: DataFrame, features: list[str], y: str, iterations: int = 200, rate: float = 0.05, max_leaves: int = 15, least_leaf: int = 100, l2: float = 10.0) -> Boosted:
    """Rows without an outcome are left out; without any row the prediction is null-free and zero."""
    rows = train.where(F.col(y).isNotNull()).select(_values(features).alias("x"), F.col(y).cast("double").alias("y"))
    inner = [(i + 1) / BINS for i in range(BINS - 1)]
    one = rows.agg(F.array(*[F.percentile_approx(F.get("x", F.lit(j)), inner, 10_000) for j in range(len(features))]).alias("q"), F.avg("y").alias("m")).first()
    edges = [np.unique(np.array(q if q is not None else [], dtype=float)) for q in one["q"]]
    model, width = Boosted(list(features), edges, float(one["m"] or 0.0)), len(features)
    if one["m"] is None or not features:
        return model
    base = model.base

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = encode(_matrix(batch, "x", width).astype(float), edges)
            ends = pa.array(np.arange(0, codes.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(codes.ravel().astype(np.int16))), batch.column("y"), pa.array(np.full(len(codes), base))], ["x", "y", "pred"])

    kind = "x array<smallint>, y double, pred double"
    held, done = cut_lineage(rows.mapInArrow(start, kind)), 0
    for i in range(iterations):
        if i - done == REFRESH:
            held, done = cut_lineage(_advanced(held, model.trees[done:], width, kind)), i
        model.trees.append(grow(_summing(held, model.trees[done:], width), max_leaves, least_leaf, l2, rate))
    return model


def _advanced(held: DataFrame, trees: list[Tree], width: int, kind: str) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _matrix(batch, "x", width).astype(np.int64)
            pred = batch.column("pred").to_numpy(zero_copy_only=False) + sum(t.predict(codes) for t in trees)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(pred)], ["x", "y", "pred"])

    return held.mapInArrow(step, kind)


def _summing(held: DataFrame, trees: list[Tree], width: int):
    """``sums`` for ``grow``: histograms of the gradient after ``trees``, by one aggregate a call."""

    def sums(tree: Tree, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        size = len(nodes) * width * (BINS + 1)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, n = np.zeros(size), np.zeros(size, dtype=np.int64)
            for batch in batches:
                codes = _matrix(batch, "x", width).astype(np.int64)
                pred = batch.column("pred").to_numpy(zero_copy_only=False) + sum((t.predict(codes) for t in trees), np.zeros(len(codes)))
                a, b = histograms(codes, pred - batch.column("y").to_numpy(zero_copy_only=False), tree.leaves(codes), nodes)
                g += a.ravel()
                n += b.ravel()
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(g[cell]), pa.array(n[cell])], ["cell", "g", "n"])

        cells = held.mapInArrow(partial, "cell bigint, g double, n bigint").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()  # nodes x features x bins
        g, n = np.zeros(size), np.zeros(size, dtype=np.int64)
        g[cells["cell"]], n[cells["cell"]] = cells["g"], cells["n"]
        shape = (len(nodes), width, BINS + 1)
        return g.reshape(shape), n.reshape(shape)

    return sums


