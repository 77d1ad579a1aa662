"""Language ID by compression with per-language zstandard raw-content dictionaries.

A language's dictionary is raw text of that language.  A text is cleaned (lower case,
letters and single spaces only), cut into ``CHUNK`` byte pieces, and every piece is
encoded with each dictionary; the language with the smallest total wins.  When the
runner-up comes within ``MIN_MARGIN`` (very short texts, which zstandard stores raw), the
text is encoded once more at ``FINE_LEVEL`` behind a carrier that ends every dictionary,
so that single matches count; if the margin is still narrow, the prediction is rejected.

Fit: a bounded sample of labelled rows, ``SAMPLE_ROWS`` per language at most, those with
the smallest hash of identifier and text, ``ROW_CHARS`` cleaned characters of each; equal
rows count once, so that neither a shared identifier nor a much repeated row fills or
empties a language's sample.  A model holds ``DICT_BYTES`` a language, and the
``MAX_LANGS`` labels with the most different rows (ties: the first by alphabet); rarer
labels are never predicted.  Prediction reads whole texts and nothing but the text.

Letters are those of Unicode category L, with the marks (M) that follow them.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and is
rejected; ties go to the alphabetically first language with margin 0; rows without a
label are not learned from; repeated rows are predicted alike; very long texts are encoded
whole, piece by piece; without any labelled row every text is ``und``; an empty table gives
an empty result; other columns pass by.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 400
ROW_CHARS = 600
DICT_BYTES = 112 * 1024
MAX_LANGS = 512
LEVEL = 6
FINE_LEVEL = 19
#: Ends every dictionary of the second look and starts every piece it encodes.
CARRIER = b" ".join(b"q%dz%dx" % (i * 37 % 100, i) for i in range(24))
CHUNK = 4096
MIN_MARGIN = 0.003

_NOT_ASCII_LETTERS = re.compile(r"[^a-z]+")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def clean(text: str | None) -> str:
    """Lower case, letters with their marks, single spaces; empty without a letter."""
    if not text:
        return ""
    low = text.lower()
    if low.isascii():
        return _NOT_ASCII_LETTERS.sub(" ", low).strip()
    return _NOT_LETTERS.sub(" ", low).strip() if _LETTER.search(low) else ""


def held_out(id_col="doc_id"):
    """The rows no model may learn from: crc32 of the identifier's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """Dictionaries by language from the labelled rows of ``docs``."""
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("langid"), F.col(id_col).cast("string"), F.col(text_col)).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    different = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    sizes = {r["lang"]: r["n"] for r in different.orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not sizes:
        return {}
    # Hashes below a language's share of the range: about 1.5 x SAMPLE_ROWS different rows, then the smallest of them.
    share = {g: min(1.0, 1.5 * SAMPLE_ROWS / n) for g, n in sizes.items()}
    top = F.create_map(*[x for g, s in share.items() for x in (F.lit(g), F.lit(s))])
    drawn = labelled.where((F.col("h").cast("double") / 2.0**64 + 0.5) <= top[F.col("lang")])
    once = drawn.groupBy("lang", "h").agg(F.first(F.substring("text", 1, 4 * ROW_CHARS)).alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = once.withColumn("rn", first).where(F.col("rn") <= SAMPLE_ROWS).collect()  # SAMPLE_ROWS x MAX_LANGS at most
    model = {}
    for g in sorted(sizes):
        own = sorted((r["h"], r["text"]) for r in rows if r["lang"] == g)
        raw = " ".join(t for _, x in own if (t := clean(x)[:ROW_CHARS])).encode()
        if raw:
            model[g] = raw[:DICT_BYTES]
    return model


class Classifier:
    """Encoders of a model."""

    def __init__(self, model: dict[str, bytes]) -> None:
        # zstandard stores no dictionary under 8 bytes: pad with spaces.
        self.langs = sorted(model)
        self.coarse = [self._encoder(model[g].rjust(8), LEVEL) for g in self.langs]
        self.fine = [self._encoder(model[g] + CARRIER, FINE_LEVEL) for g in self.langs]

    @staticmethod
    def _encoder(raw: bytes, level: int):
        par = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_dict_id=0, write_checksum=0)
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=par)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=par).compress

    @staticmethod
    def _sizes(encoders, pieces: list[bytes]) -> tuple[int, float, list[int]]:
        """(best, margin, sizes); the first language wins a tie."""
        sizes = [sum(len(enc(p)) for p in pieces) for enc in encoders]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        rest = [s for i, s in enumerate(sizes) if i != best]
        return best, 1.0 - sizes[best] / min(rest) if rest else 1.0, sizes

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language or ``und``, score, margin): margin is 1 - best / second best size."""
        raw = clean(text).encode("utf-8", "replace")
        if not raw or not self.langs:
            return "und", 0.0, 0.0
        pieces = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        best, margin, sizes = self._sizes(self.coarse, pieces)
        if margin < MIN_MARGIN:
            best, margin, sizes = self._sizes(self.fine, [CARRIER + p for p in pieces])
        # Sizes as code lengths, tempered: bits saved count one in sixteen.
        score = 1.0 / sum(math.exp(-min(700.0, (s - sizes[best]) * 8 * math.log(2) / 16)) for s in sizes)
        return self.langs[best], score, margin


_last: tuple[int, Classifier | None] = (0, None)


def classifier(model: dict[str, bytes]) -> Classifier:
    """The last model's encoders are kept in the worker process from task to task."""
    global _last
    key = hash(tuple(sorted(model.items())))
    if _last[1] is None or _last[0] != key:
        _last = (key, Classifier(model))
    return _last[1]


def predict(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN, columns: list | None = None) -> DataFrame:
    """``columns`` (default: the identifier) plus lang_pred, score, margin, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: MAX_LANGS x DICT_BYTES

    @F.pandas_udf("struct<lang_pred string, score double, margin double>")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = classifier(shared.value)
        for texts in batches:
            yield pd.DataFrame([c.predict(t) for t in texts], columns=["lang_pred", "score", "margin"])

    return (
        docs.select(*(columns or [id_col]), classify(F.col(text_col)).alias("__said"))
        .select("*", "__said.*", ((F.col("__said.lang_pred") == "und") | (F.col("__said.margin") < min_margin)).alias("rejected"))
        .drop("__said")
    )


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learn from the rows not held out, predict all: id, held_out, lang_pred, score, margin, rejected."""
    model = fit(docs.where(~held_out(id_col)), id_col=id_col)
    return predict(docs, model, id_col, columns=[F.col(id_col), held_out(id_col).alias("held_out")])


def keep_identified(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose prediction is rejected; all columns."""
    model = fit(docs.where(~held_out(id_col)), id_col=id_col)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return predict(rows, model, columns=["row"]).where("NOT rejected").select("row.*")
