import re
from collections import Counter

import numpy as np

from panelforge.llm import queries as Q
from panelforge.llm.quality import BUCKETS, _Hashes, buckets_of, judge, repeated_words

from .helpers import ODD, docs

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_query_equals_plain(spark, sf):
    """Base counts, the two distributions, scores and the threshold recomputed document by document."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in Q.op13_ngram_ratio(spark, sf).collect()}
    assert len(got) == len(rows)
    grams = {i: buckets_of(t, _Hashes()) for i, t in rows}
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if labels.get(i) == (1, 0):
            np.add.at(target, g, 1)
    p, q = raw / raw.sum(), target / target.sum()
    ratio = np.floor(np.log((p + q) / 2 / np.where(p > 0, p, 1), where=p > 0, out=np.zeros(BUCKETS)) * 1e6 + 0.5)
    step = {i: int(ratio[g].sum() // (len(g) * 1000)) for i, g in grams.items() if len(g)}
    failed = {}
    for i, t in rows:
        counts = base(t)
        assert tuple(got[i][n] for n in NAMES) == counts
        failed[i] = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert got[i].base_failed == failed[i]
    known = [(step[i], labels[i][0]) for i, _ in rows if i in labels and not failed[i] and i in step]
    cost = lambda cut: (sum((20 if fine else 0) if s < cut else (0 if fine else 1) for s, fine in known), cut)
    cut = min((cost(c) for c in {s for s, _ in known}))[1]
    assert {i: got[i].kept for i, _ in rows} == {i: not failed[i] and step.get(i, cut) >= cut for i, _ in rows}


def test_keeps_clean_and_drops_poor_documents(spark, sf):
    """Scores of documents whose labels were hidden from the fit."""
    big = sf.replace("0.001", "0.1")
    documents, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    out = judge(documents, labels.where("doc_id % 3 > 0")).where("NOT base_failed").select("row.doc_id", "kept")
    said = out.join(labels.where("doc_id % 3 = 0"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in said}
    print(n)
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) >= 0.995
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) >= 0.9


def test_odd_rows(spark):
    known = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 0, 0), (7, 1, None), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = judge(docs(spark, ODD), known).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.base_failed and not r.kept  # all short, or one repeated word
    long = [(i, f"word{i} " + " ".join(f"w{j}" for j in range(80))) for i in range(4)]
    none = spark.createDataFrame([], known.schema)
    assert all(r.kept for r in judge(docs(spark, long), none).collect())
    assert judge(docs(spark, []), known).count() == 0


def test_repeated_words():
    for text in ("a b c", "a a a a", "a b c a b c", "x a b c y a b c z", "", "a b c d e f g"):
        assert repeated_words(text.split()) == base(text)[4]
