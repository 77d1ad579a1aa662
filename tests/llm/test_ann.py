import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import queries as Q
from panelforge.llm.ann import Plan, coded, learn, neighbours, retrieve, rotations
from panelforge.llm.common import materialize


def brute(rows, k=10, every=100):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall_and_scores(spark, sf):
    big = sf.replace("0.001", "0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{big}/embeddings.parquet").collect()]
    want, x = brute(rows), {i: np.array(v, float) for i, v in rows}
    got = {}
    for r in Q.op2_multi_index_hashing(spark, big).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        assert all(math.isclose(s, float(np.sqrt(((x[v] - x[q]) ** 2).sum())), rel_tol=1e-12) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    print("recall", hits / (10 * len(want)))
    assert hits / (10 * len(want)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0, 0.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 0.5]), (8, [1.0, 0.5]), (8, [9.0, 9.0]), (9, [-1.0, 0.0]), (10, [1.0, 0.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit("y"), "score": F.lit(0)})
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours(d, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 0.5), (0, 2, 10, 0.5), (0, 3, 9, 2.0)]
    assert neighbours(d.where("false"), F.col("id") % 100 == 0).count() == 0
    assert neighbours(d.where("vec_id = 0"), F.col("id") % 100 == 0).count() == 0


def test_many_ties(spark):
    d = spark.range(3000, numPartitions=6).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).otherwise(F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 7))).alias("embedding"))
    got = {}
    for r in neighbours(d, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert [v for _, v in sorted(got[300])] == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]
    assert all(len(v) == 10 for v in got.values()) and len(got) == 30


def test_every_code_within_the_pigeonhole_radius_is_retrieved(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 24))
    x[400:] = x[:400] + 0.3 * r.normal(size=(400, 24))
    plan = Plan(width=8, near=2, parts=4, reach=11, share=0.0)  # 4 * (2 + 1) - 1
    codes = rotations(x, 64 * plan.words)
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    got = coded(rows, codes, plan, 24)
    asked = got.where("id < 50").withColumnRenamed("id", "query_id")
    pairs = {(p.query_id, p.rep) for p in retrieve(got.withColumnRenamed("id", "rep"), asked, plan).collect()}
    on = codes.bits(x, 64 * plan.words)
    # Whole codes are longer than the substrings: radius 11 of all bits is within 11 of theirs.
    assert pairs == {(i, j) for i in range(50) for j in np.flatnonzero((on != on[i]).sum(axis=1) <= 11)}
    assert len(pairs) > 50


def test_values_asked_for_are_not_broadcast(spark):
    """A query asks for thousands of values; they look as small as the queries, and must not pass the driver."""
    r = np.random.default_rng(4)
    plan = Plan(width=14, near=2, parts=18, reach=100, share=0.0)
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(r.normal(size=(200, 24)))], "id long, v array<double>")
    got = coded(rows, rotations(r.normal(size=(200, 24)), 64 * plan.words), plan, 24)
    met = retrieve(got.withColumnRenamed("id", "rep"), materialize(got.where("id < 20").withColumnRenamed("id", "query_id")), plan)
    joins = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key#" in joins and not re.search(r"BroadcastHashJoin \[key#\w+, part#", joins)


def test_close_neighbours_exclude_nearly_all_rows():
    r = np.random.default_rng(1)
    centres = r.normal(size=(400, 32))
    x = np.repeat(centres, 12, axis=0) + 0.05 * r.normal(size=(4800, 32))
    _, plan = learn(x, 10, 1_000_000, 10_000)
    assert plan.share < 0.01


def test_hot_values_and_a_common_vector(spark, monkeypatch):
    monkeypatch.setattr("panelforge.llm.common.HOT_ROWS", 4)
    r = np.random.default_rng(2)
    common = [float(a) for a in r.normal(size=16)]
    rows = [(i, common if i % 3 == 0 else [float(a) for a in r.normal(size=16)]) for i in range(1500)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute(rows), {}
    for x in neighbours(d, F.col("id") % 100 == 0).collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert set(got) == set(want)
    assert sum(len({*got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    assert sorted(got[300]) == [v for v, _ in want[300]]


def test_a_plan_that_excludes_little_says_so(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(120)]
    with pytest.warns(UserWarning, match="excludes little"):
        neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0, k=3).count()


def test_learning_holds_no_matrix_of_projections():
    """The driver fits codes on the largest sample in far less than a matrix of its projections (123 MB)."""
    import tracemalloc

    sample = np.random.default_rng(3).normal(size=(20_000, 64))
    tracemalloc.start()
    learn(sample, 10, 600_000, 6_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6
