import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import types as T

from panelforge.llm import queries as Q
from panelforge.llm.vector_codes import VantageTree, compress, exact, integers, listed, roots

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("id", "row", "vector", "error", "codes", "__key", "n")]])


def plain(rows, parts=16, entries=64, rounds=2):
    """(id, vector, label) by comparing every part with every entry, in Python integers."""
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    d = len(kept[0][1])
    cut = lambda v: [v[p * d // parts : (p + 1) * d // parts] for p in range(parts)]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    books = [list(b) for b in zip(*[cut(v) for v in list(first.values())[:entries]])]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        found = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                found[p][nearest(books[p], x)[1]].append(x)
        books = [[[sum(c) // len(f[j]) for c in zip(*f[j])] if f.get(j) else e for j, e in enumerate(b)] for b, f in zip(books, found)]
    out, by = [], defaultdict(int)
    for i, v, lab in kept:
        best = [nearest(books[p], x) for p, x in enumerate(cut(v))]
        error = sum(d2 for d2, _ in best)
        by[lab] += error
        out.append((i, "".join(f"{j:02x}" for _, j in best), error, lab))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, c, e, by[lab]) for i, c, e, lab in out), key=str), text


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, lab, *("x",) * 7) for i, v, lab in rows], SCHEMA).repartition(3)
    out, books = compress(df, **kw)
    got = out.select("id", Q.hex_code().alias("code"), "error", "label_error").collect()
    return sorted((tuple(r) for r in got), key=str), listed(books)


def test_query_equals_plain(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, text = plain(rows)
    got = Q.op11_vantage_codes(spark, sf).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=20).tolist(), i % 3 if i % 5 else None) for i in range(90)]
    rows += [(3, [0.0] * 20, 1), (3, [0.0] * 20, 1), (None, [-0.001] * 20, None), (200, None, 1), (201, [nan] * 20, 1), (202, [None] * 20, 1), (203, [inf] + [0.0] * 19, 2)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, [*rows, (204, [1.0], 1), (205, [], 1)]) == plain(rows)  # other lengths take no part
    assert run(spark, rows[:5]) == plain(rows[:5])
    assert run(spark, []) == ([], "")


def test_components_of_any_size(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=16) * 10.0 ** rng.integers(0, 8)).tolist(), 1) for i in range(80)]
    assert run(spark, rows) == plain(rows)
    huge = [(i, (rng.normal(size=16) * 10.0 ** rng.integers(0, 300)).tolist(), 1) for i in range(80)]
    want, text = plain(huge)
    got, books = run(spark, huge)
    assert books == text and [(i, c) for i, c, *_ in got] == [(i, c) for i, c, *_ in want]
    assert all(e == min(w, 2**63 - 1) for (_, _, e, _), (_, _, w, _) in zip(got, want))


def test_tree_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    for width, spread in ((4, 3), (4, 300), (1, 50), (8, 5)):
        entries = rng.integers(-spread, spread, (64, width))
        points = np.concatenate([rng.integers(-spread, spread, (400, width)), entries])
        tree = VantageTree(entries)
        index, d2 = tree.nearest(points)
        full = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == full.argmin(axis=1)).all() and (d2 == full.min(axis=1)).all()
        big = VantageTree(entries.astype(object) * 10**30)
        assert (big.nearest(points.astype(object) * 10**30)[0] == index).all()
    clustered = np.repeat(np.arange(8) * 1000, 8)[:, None] + rng.integers(0, 20, (64, 4))
    tree = VantageTree(clustered)
    tree.nearest(clustered)
    assert tree.met < 64 * 64 / 2


def test_integers_and_roots():
    assert integers(np.array([[-0.001, 0.999 / 256, 1.0]])).tolist() == [[-1, 0, 256]]
    assert integers(np.array([[1e300]])).dtype == object
    assert exact([[2**31]]).dtype == object and exact([[5]]).dtype == np.int64
    v = np.array([0, 1, 2, 3, 4, 2**52 - 1, (2**30) ** 2, (2**30) ** 2 - 1])
    down, up = roots(v)
    assert down.tolist() == [math.isqrt(int(x)) for x in v] and up.tolist() == [math.isqrt(int(x) - 1) + 1 if x else 0 for x in v]
