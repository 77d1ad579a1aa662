"""The corpus pipeline against a plain version of every stage."""

import random
import re
from collections import Counter

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from panelforge.llm.langid import MIN_MARGIN, Classifier, fit, held_out

from .helpers import ODD, docs
from .test_langid_mix_pack import check_packed, plain_mix
from .test_simhash import plain


def plain_stages(spark, d):
    """Kept ids after the language and the exact stage."""
    rows = {r.doc_id: r for r in d.collect()}
    c = Classifier(fit(d.where(~held_out())))
    told = {i: r for i, r in rows.items() if (p := c.predict(r.text))[0] != "und" and p[2] >= MIN_MARGIN}
    first = {}
    for i in sorted(told):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", told[i].text), i)
    exact = set(first.values())
    return rows, set(told), exact


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near_bounds(rows, exact):
    """Kept ids if every pair from 0.87 on, or every pair from 0.7 on, were linked."""
    sets = {i: shingles(rows[i].text) for i in exact}
    fp = {i: plain(rows[i].text, 5) for i in exact}
    out = []
    for least in (0.87, 0.7):
        parent = {i: i for i in exact}

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a in exact:
            for b in exact:
                if a < b and ((fp[a] ^ fp[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
        out.append({i for i in exact if root(i) == i})
    return out


def test_stages_and_run(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows, told, exact = plain_stages(spark, d)
    most, least = near_bounds(rows, exact)
    assert [n for n, _ in P.STAGES] == ["language", "exact", "near", "mixture", "packing"]
    got = d
    for (_, stage), want in zip(P.STAGES[:2], (told, exact)):
        got = stage(spark, got, sf)
        assert got.columns == d.columns
        assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    near = [r.doc_id for r in dict(P.STAGES)["near"](spark, got, sf).collect()]
    assert len(near) == len(set(near)) and least <= set(near) <= most
    mixed = Counter(k[0] for k in plain_mix([(i, rows[i].source) for i in near], "mix", 0.5).elements())
    packed = P.run(spark, sf).collect()
    used, bound = check_packed(packed, [(i, rows[i].text) for i in mixed.elements()])
    assert used <= bound + 2


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stage_on_odd_and_empty_rows(spark, sf, name):
    stage = dict(P.STAGES)[name]
    d = docs(spark, ODD)
    out = stage(spark, d, sf)
    if name != "packing":
        assert out.columns == d.columns
    out.collect()
    assert stage(spark, d.where("false"), sf).count() == 0


def test_planted_near_copies_go_and_clean_documents_stay(spark, sf):
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 8)))
    rows, originals = [], []
    for k in range(60):
        text = [word() for _ in range(r.randint(60, 400))]
        originals.append(1000 * k)
        rows.append((1000 * k, " ".join(text), "en", "s"))
        for c in range(3):  # each copy: one word in a hundred replaced
            copy = [word() if r.random() < 0.01 else w for w in text]
            rows.append((1000 * k + 1 + c, " ".join(copy), "en", "s"))
    kept = sorted(x.doc_id for x in dict(P.STAGES)["near"](spark, docs(spark, rows), sf).collect())
    assert set(originals) <= set(kept)
    sets = {i: shingles(t) for i, t, *_ in rows}
    missed = [i for i in kept if i not in originals and len(sets[i] & sets[i - i % 1000]) >= 0.85 * len(sets[i] | sets[i - i % 1000])]
    assert len(missed) <= 2


def test_texts_that_share_a_hash_are_both_kept(spark, monkeypatch):
    """Two unlike texts of one node: neither is dropped as a copy of the other."""
    from panelforge.llm import simhash

    monkeypatch.setattr(simhash, "text_node", lambda c: F.lit(7).cast("bigint"))
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (2, "one two three four five six seven"), (3, "one two three four five six seven")]
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(docs(spark, rows)).collect())
    assert 1 in kept and len(set(kept) & {2, 3}) >= 1
