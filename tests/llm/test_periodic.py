import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import periodic, queries as Q
from panelforge.llm.periodic import collapsed, find_runs, periodic_runs, strongest

from .helpers import ODD, docs


def plain(words):
    """Every stretch of every period, word by word; the smallest period of equal stretches."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = plain(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_plain(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r[c] for c in COLUMNS) for r in Q.op12_harmonic_runs(spark, sf).collect())
    assert got == sorted(plain_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), st.integers(1, 9)), max_size=8))
def test_runs_of_powers(blocks):
    words = [w for part, k in blocks for w in part * k]
    assert [tuple(r) for r in find_runs(words).tolist()] == plain(words)


def test_blocks_and_hash_errors(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["a" * 500, "ab" * 300 + "abc" * 200, "".join(rng.choice(list("ab"), 900)), "abaababaabaab" * 60]
    want = [plain(list(t)) for t in texts]
    monkeypatch.setattr(periodic, "BLOCK", 64)
    assert [[tuple(r) for r in find_runs(list(t)).tolist()] for t in texts] == want
    # Hashes that agree on everything: each run must still be right, as words decide.
    monkeypatch.setattr(periodic, "PRIMES", (3, 3))
    for t, w in zip(texts, want):
        assert {tuple(r) for r in find_runs(list(t)).tolist()} <= set(w)
    with pytest.raises(ValueError):
        find_runs(["a"] * 9, min_repeats=2)


def test_odd_texts(spark):
    got = {(r["row"].doc_id, r["collapsed"]): r for r in periodic_runs(docs(spark, ODD)).collect()}
    assert len(got) == len(ODD) - 1  # one row is repeated
    assert [tuple(x) for x in got[6, "word"]["runs"]] == [(0, 30_000, 1)] and tuple(got[6, "word"]["best"]) == (0, 30_000, 1)
    assert got[3, ""]["runs"] == [] and got[3, ""]["best"] is None and got[5, ""]["runs"] == []
    assert periodic_runs(docs(spark, [])).count() == 0


def test_strongest_and_collapse():
    runs = find_runs("a b a b a b a b c c c c c c x y z".split())
    assert runs.tolist() == [[0, 8, 2], [8, 6, 1]]
    assert strongest(runs) == (8, 6, 1)
    assert collapsed("a b a b a b a b c c c c c c x y z".split(), runs) == "a b c x y z".split()
