import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import queries as Q
from panelforge.llm.simhash import BKTree, components, drop_near_copies, fingerprint_links, near_components, simhash64

from .helpers import ODD, docs


def plain(text, words=3):
    """Fingerprint straight from the definition."""
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, radius=2):
    """items: (id, fp) -> smallest id reachable."""
    by = {}
    for i, f in items:
        by.setdefault(f, []).append(i)
    fps, parent = list(by), {f: f for f in by}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                parent[root(fps[a])] = root(fps[b])
    least = {}
    for f, ids in by.items():
        least[root(f)] = min([least.get(root(f), 2**63), *ids])
    return {i: least[root(f)] for i, f in items}


@given(st.text(alphabet="aB é\t\n\x0b\x1f　", max_size=30))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash64(text) == plain(text)


def test_long_text_in_chunks():
    t = " ".join(str(random.Random(1).random()) for _ in range(1)) + " w x y z" * 4000
    assert simhash64(t) == simhash64(t, chunk=97) == plain(t)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 2**64 - 1), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_bk_tree(values, q, radius):
    near = [q ^ (1 << (v % 64)) for v in values[:10]]
    tree = BKTree()
    for v in values + near:
        tree.add(v)
    assert sorted(tree.values[i] for i in tree.within(q, radius)) == sorted({v for v in values + near if (v ^ q).bit_count() <= radius})


def test_links_of_dense_groups_match_brute_force(spark):
    r = random.Random(5)
    fps = set()
    for _ in range(6):
        c = r.getrandbits(64)
        for _ in range(150):
            f = c
            for _ in range(r.randint(0, 6)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    items = [(i, f) for i, f in enumerate(fps)]
    signed = [(f - 2**64 if f >> 63 else f, i) for i, f in items]
    d = spark.createDataFrame(signed, "fp long, node long")
    for limit in (10_000, 20, 2):  # one, two and three cuts
        got = {x.node: x.component for x in components(fingerprint_links(d, limit)).collect()}
        want = brute_components(items)
        assert {i: got.get(i, i) for i, _ in items} == want


def test_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.component for r in components(e).collect()} == {0}


def test_query_matches_brute_force(spark, sf):
    rows = Q.op1_simhash_bktree(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fp = {i: plain(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in fp.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(list(fp.items()))


def test_odd_rows(spark):
    d = docs(spark, ODD)
    got = near_components(d).collect()
    assert len(got) == len(ODD)
    assert {r.component for r in got if r.fp == 0} == {3}
    out = drop_near_copies(d)
    assert out.columns == d.columns
    kept = sorted(r.doc_id for r in out.collect())
    assert kept == [1, 3, 6, 7]
    assert near_components(d.where("false")).count() == 0
    assert drop_near_copies(d.where("false")).count() == 0


def test_different_texts_of_one_identifier_are_all_kept(spark):
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (1, b), (2, c), (2, a + " end"), (3, b + " end"), (None, c)]
    got = sorted((x.doc_id, x.text) for x in drop_near_copies(docs(spark, rows)).collect())
    assert got == sorted([(1, a), (1, b), (2, c)])
