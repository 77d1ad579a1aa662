"""Operators held against plain versions and SQL twins beside their own tests."""

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm import langid, packing, queries as Q

TWINS = ["op11_vantage_codes", "op13_ngram_ratio"]


@pytest.mark.parametrize("name", TWINS)
def test_query_equals_its_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = Q.queries()[name](spark, sf).toPandas(), c.execute(Q.oracle_sql()[name]).df()
    cols, key = sorted(got.columns), got.columns[0]
    assert cols == sorted(want.columns) and len(got) == len(want) > 0
    got, want = (x[cols].sort_values(key).reset_index(drop=True).astype(str) for x in (got, want))
    assert (got == want).all().all()


def test_language_by_plain_compression(spark, sf):
    """Every text is encoded with every dictionary by the library's plainest call; the smallest total wins."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(d.where(~langid.held_out()))

    def plain(text):
        raw = langid.clean(text).encode()
        if not raw:
            return "und"
        pieces = [raw[i : i + langid.CHUNK] for i in range(0, len(raw), langid.CHUNK)]

        def total(lang, level, tail, head):
            par = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_dict_id=0, write_checksum=0)
            words = zstandard.ZstdCompressionDict((model[lang] + tail).rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=par)
            return sum(len(zstandard.ZstdCompressor(dict_data=words, compression_params=par).compress(head + p)) for p in pieces)

        sizes = {g: total(g, langid.LEVEL, b"", b"") for g in sorted(model)}
        best, second = sorted(sizes.values())[:2]
        if 1 - best / second < langid.MIN_MARGIN:
            sizes = {g: total(g, langid.FINE_LEVEL, langid.CARRIER, langid.CARRIER) for g in sorted(model)}
        return min(sorted(sizes), key=lambda g: sizes[g])

    texts = {r.doc_id: r.text for r in d.where("doc_id % 4 = 0").collect()}
    got = {r.doc_id: r.lang_pred for r in langid.identify(d).where("doc_id % 4 = 0").collect()}
    assert got == {i: plain(t) for i, t in texts.items()}


def test_both_tokenizer_engines_agree_on_any_text():
    path = packing.default_tokenizer()
    fast, plain = packing.Encoder(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(7)
    odd = [" ", "  ", "\t", "\n", "\r\n", " ", " ", "​", "　", "́", "é", "ß", "ñ", "'", "'s", "’", "🙂", "👩‍🚀", "日本", "한", "ع", "०१", "½", "12", "A", "the", "\x00", "\x7f", "\x85", "#*$", "�", "𝒳"]
    for _ in range(4000):
        parts = [odd[i] if rng.random() < 0.7 else chr(int(rng.integers(1, 0xD7FF))) for i in rng.integers(0, len(odd), int(rng.integers(1, 40)))]
        text = "".join(parts)
        assert fast.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_language_scores_need_no_identifier(spark, sf):
    """Predictions depend on the text alone: other identifiers, sources and labels change nothing once a model is fitted."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(d.where(~langid.held_out()))
    one = {r.doc_id: r.lang_pred for r in langid.predict(d, model).collect()}
    other = d.withColumns({"doc_id": -F.col("doc_id"), "lang": F.lit("xx"), "source": F.lit("y")})
    assert {-r.doc_id: r.lang_pred for r in langid.predict(other, model).collect()} == one
