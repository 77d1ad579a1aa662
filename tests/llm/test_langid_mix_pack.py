import bisect
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm import langid, mixing, packing
from panelforge.llm import queries as Q
from panelforge.llm.langid import Classifier, clean, fit, identify, keep_identified, predict
from panelforge.llm.mixing import hashed, mix, mixed_documents
from panelforge.llm.packing import Encoder, best_fit, default_tokenizer, fractional, pack, piece_starts, plan, price

from .helpers import ODD, docs


# ------------------------------------------------------------------ language ID
def test_language_accuracy_held_out(spark, sf):
    d = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in got) / len(got) < 0.01
    assert all(0 <= r.score <= 1 for r in got)
    assert len(got) == d.count()


def test_language_odd_rows(spark):
    d = docs(spark, [*ODD, (90, "12 34 !!", "en", "a"), *((100 + i, f"the quick brown fox {i} jumps over the lazy dog and the cat", "en", "a") for i in range(40)), *((200 + i, f"el zorro marrón rápido {i} salta sobre el perro perezoso y la gata", "es", "a") for i in range(40))])
    got = {r.doc_id: r for r in identify(d).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == got[90].lang_pred == "und"
    assert got[100].lang_pred == "en" and got[201].lang_pred == "es"
    assert identify(d).count() == len(ODD) + 81
    kept = keep_identified(d)
    assert kept.columns == d.columns and {100, 201} <= {r.doc_id for r in kept.collect()} and 3 not in {r.doc_id for r in kept.collect()}
    assert identify(d.where("false")).count() == 0
    unlabelled = identify(d.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_a_shared_identifier_neither_empties_nor_fills_the_sample(spark):
    for ident in (None, 5):
        d = spark.range(2000).select(F.lit(ident).cast("long").alias("doc_id"), F.concat(F.lit("the quick brown fox number "), F.rand(1).cast("string"), F.lit(" jumps over the lazy dog")).alias("text"), F.lit("en").alias("lang"))
        d = d.unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("el mismo texto repetido muchas veces").alias("text"), F.lit("es").alias("lang")))
        d = d.unionByName(spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("immer die gleiche Zeile mit einer Nummer").alias("text"), F.lit("de").alias("lang")))
        model = fit(d)
        assert set(model) == {"en", "es", "de"}
        assert 200 <= model["en"].count(b"quick") <= langid.SAMPLE_ROWS and model["de"].count(b"immer") == 1


def test_more_labels_than_the_model_holds(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    d = spark.createDataFrame([(i, f"text {i} of many words", g) for i, g in enumerate("aaaabbbcc")], "doc_id long, text string, lang string")
    assert set(fit(d)) == {"a", "b"}


def test_letters():
    assert clean("²½ Ⅷ 12 _ \u0301") == ""
    assert clean("हिन्दी 12 हिन्दी!") == "हिन्दी हिन्दी"
    assert clean("Zoë-9 naïve") == "zoë naïve" and clean("It's OK_2") == "it s ok" and clean(None) == ""


def test_prediction_reads_text_only(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = {"a": b"aaaa bbbb aaab " * 20, "z": b"zzzz yyyy zzzy " * 20}
    shuffled = d.withColumns({"lang": F.lit("q"), "source": F.lit("q")})
    one, two = (sorted(map(str, predict(x, model).collect())) for x in (d, shuffled))
    assert one == two
    assert Classifier(model).predict("zzzz yyyy")[0] == "z"


# ------------------------------------------------------------------ mixing
def plain_mix(rows, seed, temperature, total=None):
    import hashlib

    h = lambda *p: int(hashlib.md5("|".join("" if x is None else str(x) for x in p).encode()).hexdigest()[:15], 16)
    n = Counter(s for _, s in rows)
    norm = sum(c**temperature for c in n.values())
    out = Counter()
    for i, s in rows:
        rate = (len(rows) if total is None else total) * n[s] ** temperature / norm / n[s]
        parts = max(1, math.ceil(rate / mixing.PART))
        copies = 0
        for j in range(1, parts + 1):
            u, p, k = ((h(seed, i, j) >> 10) + 0.5) / 2**50, math.exp(-rate / parts), 0
            cdf = p
            while cdf <= u:
                k += 1
                p *= rate / parts / k
                cdf += p
            copies += k
        for c in range(1, copies + 1):
            out[(i, s, c, copies, h(seed, "place", i, c))] += 1
    return out


@pytest.mark.parametrize("total", [None, 400])
def test_mixture_matches_plain(spark, total):
    rows = [(i, "x " * (i % 3), "en", None if i % 7 == 0 else ("hot" if i % 3 else f"s{i % 5}")) for i in range(200)] + [(5, "again", "en", "hot"), (None, None, None, None)]
    got = mix(docs(spark, rows), "seed", total=total).collect()
    assert Counter((r.row.doc_id, r.row.source, r.copy, r.copies, r.shuffle_key) for r in got) == plain_mix([(i, s) for i, _, _, s in rows], "seed", 0.5, total)


def test_mixture_high_rates_and_salted_join(spark, monkeypatch):
    rows = [(i, "t", "en", "a" if i else "b") for i in range(30)]
    want = plain_mix([(i, s) for i, _, _, s in rows], "m", 0.0, 3000)
    for limit in (10_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
        got = mix(docs(spark, rows), "m", total=3000, temperature=0.0).collect()
        assert Counter((r.row.doc_id, r.row.source, r.copy, r.copies, r.shuffle_key) for r in got) == want


def test_mixture_weights_columns_empty(spark):
    d = docs(spark, ODD)
    w = spark.createDataFrame([("a", 1.0), (None, 1.0)], "source string, weight double")
    out = mixed_documents(d, weights=w, total=1000)
    assert out.columns == d.columns
    n = Counter(r.source for r in out.collect())
    assert set(n) == {"a", None} and all(350 < x < 650 for x in n.values())
    assert mixed_documents(d.where("false")).count() == 0
    assert spark.range(1).select(hashed(F.lit(None), F.lit("a"))).first()[0] >= 0


# ------------------------------------------------------------------ packing
def check_packed(rows, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[(d, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    return len(seqs), -(-sum(r.length for r in rows) // 2048)


def test_packing_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check_packed(Q.op6_lp_packing(spark, sf).collect(), texts)
    assert used <= least + 2


def test_packing_odd_rows(spark):
    odd = [*ODD, (50, "before <|endoftext|> after", "en", "a"), (51, "\U0001f600 naïve  \n\n tabs\t'll 12345", "en", "a")]
    d = docs(spark, odd)
    check_packed(pack(d).collect(), [(i, t) for i, t, *_ in odd])
    assert pack(d.where("false")).count() == 0
    with_ids = pack(d, emit_ids=True).where("doc_id = 1").first()
    assert len(with_ids.ids) == with_ids.length and with_ids.ids[-1] == 0


def test_encoder_equals_tokenizers(spark, sf):
    tok, enc = Tokenizer.from_file(default_tokenizer()), Encoder(default_tokenizer())
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert list(enc.ids(r.text)) == tok.encode(r.text, add_special_tokens=False).ids


def test_long_runs_of_white_space(spark):
    texts = [(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000), (3, "x " * 60_000), (4, "\u3000" * 60_001)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    check_packed(pack(d).collect(), texts)


def test_piece_starts():
    assert piece_starts(1) == [0] and piece_starts(2048) == [0] and piece_starts(2049) == [0, 1] and piece_starts(4096) == [0, 2048]


def test_price_is_the_best_value():
    r = np.random.default_rng(0)
    v = np.zeros(41)
    v[r.choice(np.arange(1, 41), 8, replace=False)] = r.random(8)
    best, _ = price(v, 40)
    slow = np.zeros(41)
    for c in range(1, 41):
        slow[c] = max([slow[c - 1], *(slow[c - n] + v[n] for n in range(1, c + 1) if v[n] > 0)])
    assert np.allclose(best, slow)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in lengths:
        i = bisect.bisect_left(gaps, x)
        gap = (gaps.pop(i) if i < len(gaps) else capacity) - x
        bisect.insort(gaps, gap)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(257, np.int64)
    counts[1:] = r.integers(0, [3, 50, 4000, 2][seed], 256)
    counts[256] = 5
    done = np.zeros(257, np.int64)
    sequences = 0
    for config, times in plan(counts, 256):
        assert sum(n * c for n, c in config) <= 256 and times > 0
        sequences += times
        for n, c in config:
            done[n] += c * times
    assert (done == counts).all()
    assert sequences <= best_fit_decreasing(np.repeat(np.arange(257), counts)[::-1], 256) * 1.005 + 1
    assert not best_fit(np.zeros(257, np.int64), 256) and not fractional(np.zeros(257, np.int64), 256)


def test_numbers_within_groups_by_two_levels_of_offsets(spark, monkeypatch):
    """Gapless in every group, one of which holds most rows, with blocks of few buckets."""
    from panelforge.llm import common

    monkeypatch.setattr(common, "BLOCK_BUCKETS", 3)
    d = spark.range(3000).select(F.when(F.col("id") % 5 > 0, 0).otherwise(F.col("id") % 7).alias("g"), F.col("id").alias("x")).unionByName(spark.range(40).select(F.lit(0).cast("long").alias("g"), F.lit(-1).cast("long").alias("x")))
    got = defaultdict(list)
    for r in common.dense_numbers(d, "n", 50, within=["g"]).collect():
        got[r.g].append(r.n)
    assert sum(map(len, got.values())) == 3040 and all(sorted(v) == list(range(len(v))) for v in got.values())
