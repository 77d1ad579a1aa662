"""Walk-forward penalised logistic regressions, all cut-offs and penalties together.

Medians, missing flags and scales of every growing sample come from ``prefix``; as there, a
standardised column is a linear form of the shifted values and missing flags, so all models
share one frame of inputs.  A Newton round is one pass over it: for each model it sums the
gradient and the curvature of the rows known before its cut-off, and the loss, by which a step
that does not help is halved.  The number of passes is that of the slowest model, whatever the
number of refits, inner blocks and penalties.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import prefix

ROUNDS, TOL = 50, 1e-9
#: Rows that a block must have for training and for validation, and rows of a calibration.
LEAST_TRAIN, LEAST_VALID, LEAST_PLATT = 100, 50, 100
#: Weights at once: models in one pass, by the size of their curvature.
MAX_CELLS = 1 << 22
#: Models of one cut-off whose chances for a batch of rows are held at once.
MODEL_BLOCK = 64


@dataclass(frozen=True)
class Model:
    cut: dt.date
    features: tuple[str, ...]
    c: float


def _basis(sums: prefix.Prefix, m: Model) -> np.ndarray:
    """[1, standardised columns] of a model as linear forms of [1, inputs]; one column each."""
    i, n_f = sums.at[m.cut], len(sums.features)
    g, n = sums.gram[i], sums.gram[i, 0, 0]
    place, cols = {c: j for j, c in enumerate(sums.features)}, []
    for j in (place[c] for c in m.features):
        if n - g[0, 1 + n_f + j] > 0:
            a = np.zeros(2 * n_f + 1)
            a[1 + j], a[1 + n_f + j] = 1.0, (sums.medians[i, j] - sums.shift[j]) / sums.unit[j]
            cols.append(a)
    for j in (place[c] for c in m.features):
        if 0 < g[0, 1 + n_f + j] < n:
            a = np.zeros(2 * n_f + 1)
            a[1 + n_f + j] = 1.0
            cols.append(a)
    first = np.zeros(2 * n_f + 1)
    first[0] = 1.0
    out = [first]
    for a in cols:
        centre, second = a @ g[:-1, 0] / n, a @ g[:-1, :-1] @ a / n
        var = second - centre**2
        z = a.copy()
        z[0] -= centre
        out.append(z / (np.sqrt(var) if var > prefix.FLAT * max(second, 1.0) else 1.0))
    return np.column_stack(out)


def fit_all(sums: prefix.Prefix, models: list[Model]) -> dict[Model, tuple[float, list[float]]]:
    """(intercept, weights of ``sums.inputs()``) of every model whose sample has rows of both classes."""
    k = 2 * len(sums.features) + 1
    out: dict[Model, tuple[float, list[float]]] = {}
    ready = []
    for m in dict.fromkeys(models):
        n, ones = sums.count(m.cut), sums.gram[sums.at[m.cut], 0, -1]
        if 0 < ones < n:
            ready.append(m)
    size = max(1, MAX_CELLS // (k * k))
    for lo in range(0, len(ready), size):
        out |= _newton(sums, ready[lo : lo + size], k)
    return out


def batch_sums(u: np.ndarray, y: np.ndarray, gap: np.ndarray, coef: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, curvature and loss of every model (a row of ``coef``) over the rows whose gap is not after its own.

    Rows are put in order of their gap, so models of one cut-off share a leading part of them
    and are taken together; products of two inputs are formed once for all models.
    """
    order = np.argsort(gap, kind="stable")
    u, y, gap = u[order], y[order], gap[order]
    i, j = np.triu_indices(u.shape[1])
    products = u[:, i] * u[:, j]
    grad, curve, loss = np.zeros(coef.shape), np.zeros((len(coef), len(i))), np.zeros((len(coef), 1))
    for g in np.unique(gaps):
        n, models = np.searchsorted(gap, g, side="right"), np.flatnonzero(gaps == g)
        for lo in range(0, len(models), MODEL_BLOCK):
            at = models[lo : lo + MODEL_BLOCK]
            eta = u[:n] @ coef[at].T
            e = np.exp(-np.abs(eta))
            p = np.where(eta >= 0, 1.0, e) / (1.0 + e)
            grad[at] += (p - y[:n, None]).T @ u[:n]
            curve[at] += (p * (1 - p)).T @ products[:n]
            loss[at, 0] += (np.maximum(eta, 0.0) + np.log1p(e)).sum(axis=0) - y[:n] @ eta
    full = np.empty((len(coef), u.shape[1], u.shape[1]))
    full[:, i, j] = full[:, j, i] = curve
    return grad, full, loss


def _newton(sums: prefix.Prefix, models: list[Model], k: int) -> dict[Model, tuple[float, list[float]]]:
    shift, unit, width = sums.shift, sums.unit, len(sums.features)
    basis = [_basis(sums, m) for m in models]
    cut = np.array([sums.at[m.cut] for m in models])
    w = [np.zeros(b.shape[1]) for b in basis]
    step: list[np.ndarray | None] = [None] * len(models)
    best = [np.inf] * len(models)
    open_ = set(range(len(models)))
    for _ in range(ROUNDS):
        if not open_:
            break
        asked = sorted(open_)
        tried = {i: w[i] if step[i] is None else w[i] + step[i] for i in asked}
        coef = np.stack([basis[i] @ tried[i] for i in asked])
        gaps = cut[asked]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, curve, loss = np.zeros((len(coef), k)), np.zeros((len(coef), k, k)), np.zeros((len(coef), 1))
            for batch in batches:
                x = prefix._matrix(batch, width)
                gap, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gap", "y"))
                miss = np.isnan(x)
                u = np.column_stack([np.ones(len(x)), np.where(miss, 0.0, (x - shift) / unit), miss])
                for own, part in zip((grad, curve, loss), batch_sums(u, y, gap, coef, gaps)):
                    own += part
            a = np.concatenate([grad, curve.reshape(len(coef), -1), loss], axis=1)
            m, cell = np.nonzero(a)
            yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(a[m, cell])], ["m", "cell", "v"])

        cells = sums.rows.mapInArrow(partial, "m int, cell int, v double").groupBy("m", "cell").agg(F.sum("v").alias("v")).toPandas()  # models x inputs squared
        a = np.zeros((len(asked), k + k * k + 1))
        a[cells["m"], cells["cell"]] = cells["v"]
        for r, i in enumerate(asked):
            b, t, c = basis[i], tried[i], models[i].c
            pen = np.r_[0.0, np.ones(len(t) - 1)] / c
            value = a[r, -1] + 0.5 * (pen * t * t).sum()
            if value > best[i] * (1 + 1e-12) + 1e-12:
                step[i] = step[i] / 2
                if np.abs(step[i]).max() < TOL:
                    open_.discard(i)
                continue
            w[i], best[i] = t, value
            g = b.T @ a[r, :k] + pen * t
            h = b.T @ a[r, k:-1].reshape(k, k) @ b + np.diag(pen)
            step[i] = -np.linalg.lstsq(h, g, rcond=None)[0]
            if np.abs(step[i]).max() < TOL:
                open_.discard(i)
    if open_:
        raise RuntimeError(f"{len(open_)} logistic regressions did not settle")
    return {m: (float((v := basis[i] @ w[i])[0]), [float(x) for x in v[1:]]) for i, m in enumerate(models)}


def _probability() -> Column:
    return 1.0 / (1.0 + F.exp(-prefix._value()))


def platt_all(rows: DataFrame, least: int = LEAST_PLATT) -> dict[int, tuple[float, float]]:
    """(slope, intercept) by group of (g, prob, y); groups with few rows or one class have none.

    All groups take their Newton steps together, one small aggregate a round.
    """
    seen = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("k")).collect()  # a row a group
    now = {r["g"]: np.zeros(2) for r in seen if r["n"] >= least and r["k"] > 1}
    held, done = rows.select("g", F.col("prob").alias("x"), F.col("y").cast("double").alias("y")), set()
    for _ in range(ROUNDS):
        left = [(g, float(a), float(b)) for g, (a, b) in now.items() if g not in done]
        if not left:
            break
        table = F.broadcast(rows.sparkSession.createDataFrame(left, "g int, a double, b double"))
        p = 1.0 / (1.0 + F.exp(-(F.col("a") * F.col("x") + F.col("b"))))
        s = held.join(table, "g").withColumns({"p": p, "e": F.col("y") - p, "v": p * (1 - p)})
        x = F.col("x")
        for r in s.groupBy("g").agg(F.sum(F.col("e") * x).alias("ga"), F.sum("e").alias("gb"), F.sum(F.col("v") * x * x).alias("haa"), F.sum(F.col("v") * x).alias("hab"), F.sum("v").alias("hbb")).collect():
            d = np.linalg.lstsq(np.array([[r["haa"], r["hab"]], [r["hab"], r["hbb"]]]), np.array([r["ga"], r["gb"]]), rcond=None)[0]
            now[r["g"]] = now[r["g"]] + d
            if np.abs(d).max() < TOL:
                done.add(r["g"])
    return {g: (float(a), float(b)) for g, (a, b) in now.items() if g in done}


def _blocks(weeks: list[tuple[dt.date, dt.date]], cut: dt.date, n_blocks: int, size: int, least_weeks: int) -> list[tuple[dt.date, dt.date, dt.date]]:
    """(train before, first, last) of the inner blocks; one block of the last weeks where there is none."""
    known = [w for w, k in weeks if k < cut]
    blocks = prefix.blocks_before(weeks, cut, n_blocks, size, least_weeks)
    if blocks or len(known) < 4:
        return blocks
    start = known[-min(size, len(known) // 4)]
    return [(start, start, known[-1])]


def walk_forward(xy: DataFrame, y: str, refits: list[dt.date], sets: dict[str, list[str]], cs=(0.01, 0.1, 1.0, 10.0), n_blocks: int = 3, size: int = 26, least_weeks: int = 104, entity: str = "ticker") -> DataFrame:
    """entity, as_of, y, prob, prob_calibrated, feature_set, refit_at, c.

    C has the smallest mean Brier score over the refit's inner blocks (ties: the smaller; the
    middle one without a usable block); the calibration is fitted on the blocks' out-of-fold
    probabilities under that C, and null where they are too few or of one class.
    """
    refits, cs = sorted(refits), sorted(cs)
    features = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    held = cut_lineage(xy.select(*dict.fromkeys([entity, "as_of", "label_end_at", "label_available_at", "label_status", y, *features])))
    spark, weeks = xy.sparkSession, prefix.training_weeks(held, y)
    wanted = {r: _blocks(weeks, r, n_blocks, size, least_weeks) for r in refits}
    sums = prefix.Prefix(held, features, y, [*refits, *(b[0] for own in wanted.values() for b in own)])
    spans = [(r, before, first, last) for r, own in wanted.items() for before, first, last in own if sums.count(before) >= LEAST_TRAIN]
    fits = fit_all(sums, [Model(s[1], tuple(cols), c) for s in spans for cols in sets.values() for c in cs])
    table = [(i, name, float(c), *fits[m]) for i, s in enumerate(spans) for name, cols in sets.items() for c in cs if (m := Model(s[1], tuple(cols), c)) in fits]
    schema, chosen, valid = "block int, feature_set string, c double, b double, w array<double>", {}, None
    scores: dict[tuple, list[float]] = defaultdict(list)
    if table:
        where = F.array_compact(F.array(*[F.when(F.col("as_of").between(F.lit(first), F.lit(last)) & (prefix.known_at() < F.lit(r).cast("timestamp")), F.lit(i)) for i, (r, _, first, last) in enumerate(spans)]))
        rows = held.where(prefix.trainable(y)).select(F.col(y).cast("double").alias("y"), sums.inputs().alias("u"), F.explode(where).alias("block"))
        valid = cut_lineage(rows.join(F.broadcast(spark.createDataFrame(table, schema)), "block").select("block", "feature_set", "c", "y", _probability().alias("prob")))
        for r in valid.groupBy("block", "feature_set", "c").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prob") - F.col("y")) ** 2).alias("s")).where(F.col("n") >= LEAST_VALID).orderBy("block").collect():  # a row a block and penalty
            scores[spans[r["block"]][0], r["feature_set"], r["c"]].append((r["block"], r["s"]))
    usable = defaultdict(set)
    for r in refits:
        for name in sets:
            means = {c: round(sum(s for _, s in own) / len(own), 12) for c in cs if (own := scores.get((r, name, float(c))))}
            chosen[r, name] = min(means, key=lambda c: (means[c], c)) if means else cs[len(cs) // 2]
            usable[r, name] = {b for b, _ in scores.get((r, name, float(chosen[r, name])), [])}
    groups = {key: g for g, key in enumerate(chosen)}
    platt: dict[int, tuple[float, float]] = {}
    if valid is not None and any(usable.values()):
        pick = [(groups[key], b, key[1], float(chosen[key])) for key, own in usable.items() for b in own]
        picked = spark.createDataFrame(pick, "g int, block int, feature_set string, c double")
        platt = platt_all(valid.join(F.broadcast(picked), ["block", "feature_set", "c"]).select("g", "prob", "y"))
    final = fit_all(sums, [Model(r, tuple(sets[name]), chosen[r, name]) for r, name in chosen])
    at = {r: i for i, r in enumerate(refits)}
    out = [(at[r], name, r, float(c), *final[m], *platt.get(groups[r, name], (None, None))) for (r, name), c in chosen.items() if (m := Model(r, tuple(sets[name]), c)) in final]
    table = spark.createDataFrame(out, "i int, feature_set string, refit_at date, c double, b double, w array<double>, slope double, level double")
    rows = held.select(entity, "as_of", y, sums.inputs().alias("u"), (prefix._before(refits, F.col("as_of").cast("timestamp")) - 1).alias("i"))
    scored = rows.join(F.broadcast(table), "i").withColumn("prob", _probability())
    calibrated = 1.0 / (1.0 + F.exp(-(F.col("slope") * F.col("prob") + F.col("level"))))
    return scored.select(entity, "as_of", y, "prob", calibrated.alias("prob_calibrated"), "feature_set", "refit_at", "c")
