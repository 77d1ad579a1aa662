"""Walk-forward ridge regressions from cumulative sums, whatever the number of refits.

A row becomes known at one moment (its label's end, its label's publication and its own date,
the latest).  Rows are summed once, into one Gram array for each gap between two training
cut-offs; the sums of any training sample are then a running sum over the gaps.  Missing
values do not spoil that: with ``x0`` the value or zero and ``m`` whether it is missing, an
imputed column is ``x0 + median * m``, so medians, centres, scales and penalties only change
the small linear system, which is solved on the driver.  Medians of growing samples come from
a histogram by gap and one look at the values of the bins that hold a median; they are exact.

So the jobs of a walk-forward are: dates, scales, one summing pass, one pass for medians, one
ranking pass over all inner validation blocks and penalties, and one scoring pass.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..session import cut_lineage
from . import evaluate, forecast

#: Bins of the histogram that brackets a median.
BINS = 512
#: Later than any date of a panel.
NEVER = dt.date(9999, 12, 31)
#: Share of its second moment below which a variance is none.
FLAT = 1e-13


def known_at() -> Column:
    """When a row's label and its own date have passed; null if any of them is missing."""
    days = [F.col(c).cast("timestamp") for c in ("label_end_at", "label_available_at", "as_of")]
    there = days[0].isNotNull() & days[1].isNotNull() & days[2].isNotNull()
    return F.when(there, F.greatest(*days))


def trainable(y: str) -> Column:
    return (F.col("label_status") == "ok") & F.col(y).isNotNull() & known_at().isNotNull()


def _before(cuts: list[dt.date], at: Column) -> Column:
    """How many of the (ascending) dates are not after ``at``."""
    return F.size(F.filter(F.array(*[F.lit(c).cast("timestamp") for c in cuts]), lambda c: c <= at)) if cuts else F.lit(0)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width)


class Prefix:
    """Sums of all rows of ``xy`` known before each of ``cuts``."""

    def __init__(self, xy: DataFrame, features: list[str], y: str, cuts: list[dt.date]) -> None:
        self.features, self.y, self.cuts = list(dict.fromkeys(features)), y, sorted(set(cuts))
        self.at = {c: i for i, c in enumerate(self.cuts)}
        values = [W.finite(F.col(c).cast("double")) for c in self.features]
        rows = xy.where(trainable(y)).select(_before(self.cuts, known_at()).alias("gap"), F.array(*values).alias("x"), F.col(y).cast("double").alias("y"))
        self.rows = cut_lineage(rows.where(F.col("gap") < len(self.cuts)))  # read by every later pass
        f = range(len(self.features))
        x = lambda j: F.get("x", F.lit(j))
        inner = [(i + 1) / BINS for i in range(BINS - 1)]
        one = self.rows.agg(F.array(*[F.avg(x(j)) for j in f]).alias("m"), F.array(*[F.stddev_pop(x(j)) for j in f]).alias("s"), F.array(*[F.percentile_approx(x(j), inner, 10_000) for j in f]).alias("q")).first()
        self.shift = np.array([v or 0.0 for v in one["m"]])
        self.unit = np.array([v or 1.0 for v in one["s"]])
        self.edges = [np.unique(np.array(q if q is not None else [], dtype=float)) for q in one["q"]]
        self._sum()
        self._find_medians()

    def _sum(self) -> None:
        """Gram arrays and histograms by gap, in one pass over the rows."""
        n_f, gaps, shift, unit, edges = len(self.features), len(self.cuts), self.shift, self.unit, self.edges
        k = 2 * n_f + 2

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gram, hist = np.zeros((gaps, k, k)), np.zeros((gaps, n_f, BINS + 1))
            for batch in batches:
                x, gap = _matrix(batch, n_f), batch.column("gap").to_numpy(zero_copy_only=False)
                miss = np.isnan(x)
                u = np.column_stack([np.ones(len(x)), np.where(miss, 0.0, (x - shift) / unit), miss, batch.column("y").to_numpy(zero_copy_only=False)])
                for g in np.unique(gap):
                    own = gap == g
                    gram[g] += u[own].T @ u[own]
                for j in range(n_f):
                    there = ~miss[:, j]
                    np.add.at(hist, (gap[there], j, np.searchsorted(edges[j], x[there, j])), 1.0)
            for kind, a in (("gram", gram.reshape(gaps, -1)), ("hist", hist.reshape(gaps, -1))):
                g, cell = np.nonzero(a)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(g)), pa.array(g.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(a[g, cell])], ["kind", "gap", "cell", "v"])

        cells = self.rows.mapInArrow(partial, "kind string, gap int, cell int, v double").groupBy("kind", "gap", "cell").agg(F.sum("v").alias("v")).collect()  # gaps x (features squared + bins)
        gram, hist = np.zeros((gaps, k * k)), np.zeros((gaps, n_f * (BINS + 1)))
        for r in cells:
            (gram if r["kind"] == "gram" else hist)[r["gap"], r["cell"]] = r["v"]
        self.gram = np.cumsum(gram, axis=0).reshape(gaps, k, k)
        self.hist = np.cumsum(hist, axis=0).reshape(gaps, n_f, BINS + 1)

    def _find_medians(self) -> None:
        """Exact medians of every growing sample: only values of the bins that hold one are put in order."""
        self.medians = np.full((len(self.cuts), len(self.features)), np.nan)
        wanted: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)  # (feature, bin): (cut, rank in the bin)
        for i in range(len(self.cuts)):
            for j in range(len(self.features)):
                upto = np.cumsum(self.hist[i, j])
                n = int(upto[-1])
                for rank in sorted({(n - 1) // 2, n // 2}) if n else []:
                    b = int(np.searchsorted(upto, rank, side="right"))
                    wanted[j, b].append((i, rank - int(upto[b - 1] if b else 0)))
        if not wanted:
            return
        bins = {j: np.array(sorted(b for f, b in wanted if f == j)) for j, _ in wanted}
        edges, n_f = self.edges, len(self.features)

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, gap, out = _matrix(batch, n_f), batch.column("gap").to_numpy(zero_copy_only=False), []
                for j, own in bins.items():
                    at = np.flatnonzero(~np.isnan(x[:, j]))
                    b = np.searchsorted(edges[j], x[at, j])
                    keep = np.isin(b, own)
                    at, b = at[keep], b[keep]
                    out.append((np.full(len(at), j, np.int32), b.astype(np.int32), gap[at].astype(np.int32), x[at, j]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["j", "b", "gap", "x"])

        spark = self.rows.sparkSession
        values = self.rows.mapInArrow(inside, "j int, b int, gap int, x double").groupBy("j", "b", "gap", "x").agg(F.count(F.lit(1)).alias("n"))
        asked = spark.createDataFrame([(j, b, i, r) for (j, b), own in wanted.items() for i, r in own], "j int, b int, cut int, rank long")
        samples = asked.select("j", "b", "cut").distinct()
        grown = values.join(F.broadcast(samples), (values["j"] == samples["j"]) & (values["b"] == samples["b"]) & (values["gap"] <= samples["cut"])).select(samples["j"], samples["b"], "cut", "x", "n")
        w = Window.partitionBy("j", "b", "cut").orderBy("x")
        placed = grown.groupBy("j", "b", "cut", "x").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w))
        hit = placed.join(F.broadcast(asked), ["j", "b", "cut"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        for r in hit.groupBy("cut", "j").agg(F.avg("x").alias("m")).collect():  # a row a cut-off and feature
            self.medians[r["cut"], r["j"]] = r["m"]

    def count(self, cut: dt.date) -> int:
        return int(self.gram[self.at[cut], 0, 0])

    def ridges(self, cut: dt.date, features: list[str], alphas: list[float]) -> list[tuple[float, list[float]]]:
        """By penalty: (intercept, weights of ``inputs()``) of the ridge regression on the rows known before ``cut``."""
        i, n_f = self.at[cut], len(self.features)
        g, n = self.gram[i], self.gram[i, 0, 0]
        columns, place = [], {c: j for j, c in enumerate(self.features)}
        for j in (place[c] for c in features):
            if n - g[0, 1 + n_f + j] > 0:
                a = np.zeros(2 * n_f + 1)
                a[1 + j], a[1 + n_f + j] = 1.0, (self.medians[i, j] - self.shift[j]) / self.unit[j]
                columns.append(a)
        for j in (place[c] for c in features):
            if 0 < g[0, 1 + n_f + j] < n:
                a = np.zeros(2 * n_f + 1)
                a[1 + n_f + j] = 1.0
                columns.append(a)
        mean_y = g[0, -1] / n
        if not columns:
            return [(float(mean_y), [0.0] * (2 * n_f)) for _ in alphas]
        a = np.column_stack(columns)
        second, centre = a.T @ g[:-1, :-1] @ a / n, a.T @ g[:-1, 0] / n
        cov = second - np.outer(centre, centre)
        var = np.diag(cov)
        scale = np.sqrt(np.where(var > FLAT * np.maximum(np.diag(second), 1.0), var, 1.0))
        z, b = n * cov / np.outer(scale, scale), (a.T @ g[:-1, -1] - n * centre * mean_y) / scale
        out = []
        for alpha in alphas:
            w = np.linalg.solve(z + alpha * np.eye(len(b)), b) / scale
            out.append((float(mean_y - w @ centre), [float(v) for v in (a @ w)[1:]]))
        return out

    def inputs(self) -> Column:
        """The columns that weights apply to: shifted and scaled values, then missing flags."""
        x = [W.finite(F.col(c).cast("double")) for c in self.features]
        return F.array(*[F.coalesce((v - float(s)) / float(u), F.lit(0.0)) for v, s, u in zip(x, self.shift, self.unit)], *[v.isNull().cast("double") for v in x])


def _value(b: str = "b", w: str = "w", u: str = "u") -> Column:
    return F.aggregate(F.zip_with(F.col(w), F.col(u), lambda x, y: x * y), F.col(b), lambda a, v: a + v)


def training_weeks(xy: DataFrame, y: str) -> list[tuple[dt.date, dt.date]]:
    """(as_of, day on which its first row became known) of the weeks with a trainable row."""
    rows = xy.where(trainable(y)).groupBy("as_of").agg(F.to_date(F.min(known_at())).alias("k")).collect()  # dates of a weekly panel
    return sorted((r["as_of"], r["k"]) for r in rows)


def blocks_before(weeks: list[tuple[dt.date, dt.date]], cut: dt.date, n_blocks: int = 3, size: int = 26, least_weeks: int = 104) -> list[tuple[dt.date, dt.date, dt.date]]:
    """Inner forward blocks (train before, first, last) of the sample known before ``cut``."""
    return forecast.inner_blocks([w for w, k in weeks if k < cut], n_blocks, size, least_weeks)


def select_alphas(xy: DataFrame, sums: Prefix, wanted: dict[dt.date, list[tuple]], sets: dict[str, list[str]], alphas, least: int = 30) -> dict[tuple[dt.date, str], float]:
    """By cut-off and feature set: the penalty of the best mean rank IC over the cut-off's inner blocks; ties take the larger.

    All blocks of all cut-offs are ranked in one pass: a row is laid out once for every block
    and penalty that it validates.
    """
    spark, fits, spans = xy.sparkSession, [], []
    for cut, blocks in wanted.items():
        for before, first, last in blocks:
            if sums.count(before) < 100:
                continue
            spans.append((len(spans), cut, first, last))
            for name, cols in sets.items():
                fits += [(spans[-1][0], name, float(a), b, w) for a, (b, w) in zip(alphas, sums.ridges(before, cols, list(alphas)))]
    scores: dict[tuple, list[float]] = defaultdict(list)
    if spans:
        y = sums.y
        table = spark.createDataFrame(fits, "block int, feature_set string, alpha double, b double, w array<double>")
        where = F.array_compact(F.array(*[F.when(F.col("as_of").between(F.lit(first), F.lit(last)) & (known_at() < F.lit(cut).cast("timestamp")), F.lit(i)) for i, cut, first, last in spans]))
        rows = xy.where(trainable(y)).select("as_of", y, sums.inputs().alias("u"), F.explode(where).alias("block"))
        rows = rows.join(F.broadcast(table), "block").select("block", "feature_set", "alpha", "as_of", y, _value().alias("pred"))
        ic = evaluate.weekly_rank_ic(rows, "pred", y, least, ("block", "feature_set", "alpha", "as_of")).groupBy("block", "feature_set", "alpha").agg(F.avg("ic").alias("ic"), F.count("ic").alias("n"))
        for r in ic.where("n >= 5").orderBy("block").collect():  # a row a block and penalty
            scores[spans[r["block"]][1], r["feature_set"], r["alpha"]].append(r["ic"])
    out = {}
    for cut in wanted:
        for name in sets:
            means = {a: round(sum(s) / len(s), 12) for a in alphas if (s := scores.get((cut, name, float(a))))}
            out[cut, name] = max(means, key=lambda a: (means[a], a)) if means else max(alphas)
    return out


def walk_forward(xy: DataFrame, y: str, refits: list[dt.date], sets: dict[str, list[str]], alpha: float | None, alphas=(0.1, 1.0, 10.0, 100.0), horizon_end=None, entity: str = "ticker", least: int = 30, **blocks) -> DataFrame:
    """entity, as_of, y, pred, feature_set, refit_at, alpha: predictions from each refit up to the next.

    ``alpha`` None: chosen at each refit and for each set by its inner blocks.
    """
    refits = sorted(refits)
    features = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    held = cut_lineage(xy.select(*dict.fromkeys([entity, "as_of", "label_end_at", "label_available_at", "label_status", y, *features])))
    weeks = training_weeks(held, y) if alpha is None else []
    wanted = {r: blocks_before(weeks, r, **blocks) for r in refits} if alpha is None else {}
    sums = Prefix(held, features, y, [*refits, *(b[0] for own in wanted.values() for b in own)])
    chosen = select_alphas(held, sums, wanted, sets, alphas, least) if alpha is None else {(r, name): alpha for r in refits for name in sets}
    fits = []
    for i, r in enumerate(refits):
        if sums.count(r):
            for name, cols in sets.items():
                a = chosen[r, name]
                fits += [(i, name, r, float(a), *sums.ridges(r, cols, [a])[0])]
    table = held.sparkSession.createDataFrame(fits, "i int, feature_set string, refit_at date, alpha double, b double, w array<double>")
    rows = held.where(F.col("as_of") < F.lit(horizon_end)) if horizon_end is not None else held
    rows = rows.select(entity, "as_of", y, sums.inputs().alias("u"), (_before(refits, F.col("as_of").cast("timestamp")) - 1).alias("i"))
    return rows.join(F.broadcast(table), "i").select(entity, "as_of", y, _value().alias("pred"), "feature_set", "refit_at", "alpha")
