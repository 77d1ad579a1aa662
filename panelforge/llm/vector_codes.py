"""Compact codes of vectors: product quantisation whose entries are found through vantage-point trees.

Components become integers, ``floor(scale * x)``; a vector is cut into consecutive parts and
every part is replaced by the index of the nearest entry of its position's codebook.  The
codebooks start as the vectors of the smallest identifiers and are refined by a fixed number
of rounds (assign, then replace every used entry by the floor of its parts' means).

Nearest entries come from one vantage-point tree per part position (``VantageTree``): a node
holds an entry and splits the others by their distance from it.  Radii are whole numbers
rounded outwards, so a branch is left out only when no entry in it can be as near as the best
one met; branches that can tie are visited, and every decision is made on integer squared
distances with ties to the lower index.  The result is exactly that of comparing all entries.

A task adds up the parts of its own rows; only these sums (entries x components, as limbs of
32 bits, so that no sum can overflow) are shuffled, and the codebooks, whose size does not
depend on the rows, travel to the driver and back.

Defined cases: null vectors, vectors with null or non-finite components, and vectors of
another length than the most frequent one (ties: the shorter) take no part; a null identifier
sorts last, rows sharing an identifier give one first entry (their smallest vector) and are
all encoded; fewer identifiers than entries make shorter codebooks; parts of a length that
does not divide are as equal as possible; components of any finite size are exact (beyond 64
bits in Python integers, errors above the largest long are that long); an empty table gives an
empty result; columns of any name may be present.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, materialize, spread_join

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries of a tree's leaf, compared at once.
LEAF = 8
#: Components worked on at once in a task.
BLOCK = 1 << 20
LIMB = 32
_LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exactly: int64 where squared distances fit it, else Python integers."""
    top = float(np.abs(x).max(initial=0.0)) * scale
    if top < 2.0**30 and 4.0 * top * top * max(1, x.shape[-1]) < 2.0**62:
        return np.floor(x * scale).astype(np.int64)
    flat = [n * scale // d for n, d in (v.as_integer_ratio() for v in x.ravel().tolist())]
    out = np.empty(len(flat), dtype=object)
    out[:] = flat
    return out.reshape(x.shape)


def exact(rows: list[list[int]]) -> np.ndarray:
    """Integer rows as an array of int64 where they are small, else of Python integers."""
    width = len(rows[0]) if rows else 0
    top = max((abs(v) for r in rows for v in r), default=0)
    small = 4 * top * top * max(1, width) < 1 << 62
    return np.array(rows, dtype=np.int64 if small else object).reshape(len(rows), width)


def squares(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=-1) if a.shape[-1] else np.zeros(a.shape[:-1], dtype=a.dtype)


def roots(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots rounded down and up to whole numbers, exactly."""
    if d2.dtype == object:
        down = np.array([math.isqrt(int(v)) for v in d2], dtype=object)
    else:
        down = np.sqrt(d2.astype(np.float64)).astype(np.int64)
        down -= down * down > d2
        down += (down + 1) * (down + 1) <= d2
    return down, down + (down * down < d2)


class VantageTree:
    """Nearest entry under squared Euclidean distance, ties to the lower index."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF) -> None:
        self.entries, self.leaf = entries, leaf
        #: Point and entry pairs whose distance was computed.
        self.met = 0
        self.root = self._node(np.arange(len(entries)))

    def _node(self, ids: np.ndarray):
        if len(ids) <= self.leaf:
            return np.sort(ids)
        at, rest = ids[0], ids[1:]
        d2 = squares(self.entries[rest] - self.entries[at])
        order = np.argsort(d2, kind="stable")
        half = len(rest) // 2
        sides = []
        for side in (order[:half], order[half:]):
            down, up = roots(d2[side])
            sides.append((down.min(), up.max(), self._node(rest[side])))
        return at, d2[order[half]], sides

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of every point's nearest entry."""
        entries = self.entries
        if points.dtype == object or entries.dtype == object:
            points, entries = points.astype(object), entries.astype(object)
        far = 1 << 4200 if points.dtype == object else np.iinfo(np.int64).max
        best = np.full(len(points), far, dtype=points.dtype)
        index = np.full(len(points), len(entries), dtype=np.int64)

        def meet(at: np.ndarray, d2: np.ndarray, found: np.ndarray | int) -> None:
            better = (d2 < best[at]) | ((d2 == best[at]) & (found < index[at]))
            hit = at[better]
            best[hit] = d2[better]
            index[hit] = found if np.isscalar(found) else found[better]

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                d2 = squares(points[at][:, None, :] - entries[node][None, :, :])
                self.met += d2.size
                first = np.argmin(d2, axis=1)  # ids ascend: the first minimum is the lower index
                meet(at, d2[np.arange(len(at)), first], node[first])
                return
            entry, middle, sides = node
            d2 = squares(points[at] - entries[entry])
            self.met += len(at)
            meet(at, d2, int(entry))
            down, up = roots(d2)
            inner = d2 < middle
            for own, (_, _, child) in zip((inner, ~inner), sides):
                visit(child, at[own])
            for other, (low, high, child) in zip((~inner, inner), sides):
                gap = np.maximum(np.maximum(low - up[other], down[other] - high), 0)
                rest = at[other]
                visit(child, rest[gap * gap <= best[rest]])

        if len(entries):
            visit(self.root, np.arange(len(points)))
        return index, best


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """Bounds of consecutive parts as equal as possible."""
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def usable(vector: str, dim: int | None = None) -> Column:
    """The vector is not null, has finite components only, and the given length."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & (F.lit(True) if dim is None else F.size(v) == dim), F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch], vector: str, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, BLOCK // max(1, dim))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            flat = piece.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield piece, flat.reshape(piece.num_rows, dim)


def first_books(rows: DataFrame, vector: str, id_col: str, dim: int, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """By part position: the parts of the vectors of the ``entries`` smallest identifiers."""
    ids = [r[0] for r in rows.select(id_col).distinct().orderBy(F.col(id_col).asc_nulls_last()).limit(entries).collect()]
    known = F.col(id_col).isin([i for i in ids if i is not None])
    wanted = rows.where(known | F.col(id_col).isNull() if None in ids else known)
    one = {r[0]: r[1] for r in wanted.groupBy(F.col(id_col).alias("__id")).agg(F.min(vector)).collect()}  # ``entries`` rows at most
    whole = integers(np.array([one[i] for i in ids], dtype=np.float64).reshape(len(ids), dim), scale)
    return [whole[:, a:b] for a, b in cuts(dim, parts)]


def refined(rows: DataFrame, vector: str, dim: int, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """One round: every entry used becomes the floor of the mean of the parts assigned to it."""
    shared, bounds = rows.sparkSession.sparkContext.broadcast(books), cuts(dim, len(books))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(b) for b in shared.value]
        totals = [np.zeros((len(b), b.shape[1] + 1), dtype=object) for b in shared.value]
        for _, x in _blocks(batches, vector, dim):
            whole = integers(x, scale)
            for (a, b), tree, total in zip(bounds, trees, totals):
                index, _ = tree.nearest(whole[:, a:b])
                own = np.zeros(total.shape, dtype=whole.dtype)
                np.add.at(own, index, np.concatenate([whole[:, a:b], np.ones((len(whole), 1), dtype=whole.dtype)], axis=1))
                total += own
        out: list[tuple[int, int, int, int, int]] = []
        for p, total in enumerate(totals):
            for e, j in zip(*np.nonzero(total)):
                v, limb = int(total[e, j]), 0
                while not -(1 << LIMB - 1) <= v < 1 << LIMB - 1:
                    out.append((p, int(e), int(j), limb, v & (1 << LIMB) - 1))
                    v, limb = v >> LIMB, limb + 1
                out.append((p, int(e), int(j), limb, v))
        cells = np.array(out, dtype=np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells.T], ["part", "entry", "at", "limb", "v"])

    partial = rows.select(vector).mapInArrow(sums, "part bigint, entry bigint, at bigint, limb bigint, v bigint")
    cells = partial.groupBy("part", "entry", "at", "limb").agg(F.sum("v").alias("v")).collect()  # codebook cells x limbs
    totals: dict[tuple[int, int, int], int] = {}
    for r in cells:
        k = (r["part"], r["entry"], r["at"])
        totals[k] = totals.get(k, 0) + (r["v"] << LIMB * r["limb"])
    out = []
    for p, book in enumerate(books):
        width, new = book.shape[1], book.tolist()
        for e in range(len(new)):
            if n := totals.get((p, e, width), 0):
                new[e] = [totals.get((p, e, j), 0) // n for j in range(width)]
        out.append(exact(new))
    return out


def listed(books: list[np.ndarray]) -> str:
    """All components by part, entry and position, comma-joined."""
    return ",".join(str(int(v)) for b in books for v in b.ravel())


def encode(rows: DataFrame, vector: str, dim: int, books: list[np.ndarray], keep: list[str], scale: int = SCALE) -> DataFrame:
    """``keep`` plus codes (array of indexes in part order) and error (squared distances summed)."""
    shared, bounds = rows.sparkSession.sparkContext.broadcast(books), cuts(dim, len(books))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(b) for b in shared.value]
        for piece, x in _blocks(batches, vector, dim):
            whole = integers(x, scale)
            found = [tree.nearest(whole[:, a:b]) for (a, b), tree in zip(bounds, trees)]
            codes = np.stack([i for i, _ in found], axis=1)
            error = [min(_LONG, int(v)) for v in sum(d.astype(object) for _, d in found)]
            ends = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
            arrays = [piece.column(c) for c in keep] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel().astype(np.int32))), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "codes", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.select(*keep, vector).mapInArrow(coded, f"{schema}, codes array<int>, error bigint")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks).  Rows: id, label, codes, error, label_error (errors of equal labels summed, nulls together)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector).alias("vector")).where(usable("vector"))
    lengths = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 0
    rows = rows.where(F.size("vector") == dim)
    books = first_books(rows, "vector", "id", dim, parts, entries, scale) if lengths else [np.zeros((0, 0), dtype=np.int64)] * parts
    for _ in range(rounds if lengths else 0):
        books = refined(rows, "vector", dim, books, scale)
    done = materialize(encode(rows, "vector", dim, books, ["id", "label"], scale)).withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = materialize(done.groupBy("__key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")))
    sums = sums.select("__key", F.least("s", F.lit(_LONG).cast("decimal(38,0)")).cast("bigint").alias("label_error"), "n")
    if sums.count() <= BROADCAST_KEYS:
        out = done.join(F.broadcast(sums.drop("n")), "__key")
    else:
        out = spread_join(done, sums, "__key", done.count(), "id")
    return out.drop("__key"), books


def hex_code(codes: str = "codes") -> Column:
    """Two hex digits an index, in part order."""
    return F.array_join(F.transform(F.col(codes), lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(listed(books).encode()).hexdigest()
