"""Links of shingle similarity against all pairs."""

import random

from panelforge.llm.common import may_hold
from panelforge.llm.similar import shingle_sets, similar_links

from .helpers import docs


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def word(r):
    return "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7))


def test_pairs_near_the_threshold_are_decided_exactly(spark):
    r = random.Random(5)
    rows, want = [], set()
    for k in range(300):
        text = [word(r) for _ in range(200)]
        copy = text[: r.randint(165, 190)]
        copy += [word(r) for _ in range(200 - len(copy))]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
        if jaccard(rows[-1][1], rows[-2][1]) >= 0.8:
            want.add((2 * k + 1, 2 * k))
    got = {(x.a, x.b) for x in similar_links(docs(spark, rows)).collect()}
    assert 100 < len(want) < 250
    print(len(want), "pairs from 0.8 on; missed", len(want - got), "wrong", len(got - want))
    assert got <= want and len(want - got) <= 1


def grouped(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


def test_every_pair_of_a_bucket_is_connected_or_ruled_out(spark):
    r = random.Random(6)
    rows = []
    for g in range(2):  # an original in the middle; variants over 0.8 to it and under 0.75 to each other
        text = [word(r) for _ in range(400)]
        for v in range(61):
            t = list(text)
            if v != 30:
                for at in r.sample(range(0, 390, 6), 8):
                    t[at + 4] = word(r)
            rows.append((100 * g + v, " ".join(t)))
    shared = [word(r) for _ in range(300)]
    for p in range(30):  # pairs of near copies that share a long passage with all the others
        own = [word(r) for _ in range(100)]
        rows += [(1000 + p, " ".join(shared + own)), (2000 - p, " ".join(shared + own[:90] + [word(r) for _ in range(10)]))]
    want = grouped([i for i, _ in rows], [(a, b) for a, t in rows for b, u in rows if b < a and jaccard(t, u) >= 0.8])
    assert len(set(want.values())) == 32
    for block in (512, 4):
        got = grouped(want, [(x.a, x.b) for x in similar_links(docs(spark, rows), block=block).collect()])
        print(sum(got[i] != want[i] for i in want), "of", len(want), "documents in another group")
        assert got == want


def test_only_named_texts_travel(spark):
    """The filter before the exact join loses no key and passes few others."""
    rows = spark.range(-20_000, 20_000).withColumnRenamed("id", "k")
    keys = rows.where("k % 20 = 0")
    got = {r.k for r in may_hold(rows, keys, "k").collect()}
    named = {k for k in range(-20_000, 20_000) if k % 20 == 0}
    assert named <= got and len(got - named) < 0.1 * 38_000
    assert may_hold(rows, keys.where("false"), "k").count() == 0
    texts = spark.createDataFrame([(i, f"word{i} " * 9) for i in range(50)], "id long, text string")
    sets = shingle_sets(texts, texts.where("id < 3").select("id"), 5, "id", "text")
    assert {r.id for r in sets.collect()} == {0, 1, 2} and "__bits" in sets._jdf.queryExecution().optimizedPlan().toString()
