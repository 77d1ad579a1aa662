"""Quality rules: base counts, and a hashed n-gram likelihood ratio of a trusted target against the corpus.

Words are ``[^\\x20\\x09-\\x0D]+``.  Tokens for the ratio are runs of letters and digits or runs of
other signs of the lower-cased words; their unigrams and bigrams are hashed into ``BUCKETS``.
Two multinomials over the buckets are counted over whole tables: the raw one over all
documents, the target over the trusted ones (every label of the document says quality 1 and
not toxic).  The target is smoothed by as much of the raw distribution as it has counts
itself, so that a bucket without a trusted count costs log 2 at most, at any size of the
corpus.  A document's score is the mean log ratio of its n-grams, in integers: ratios are
rounded to 1e-6 nats once a bucket, so sums do not depend on their order.

Every document is judged by one threshold: the score, in steps of 1/1000 nat, that makes the
least weighted errors on the labelled documents that pass the base rules; a trusted one
rejected counts ``CLEAN_WEIGHT`` times, ties keep more.  Without a trusted document nothing is
rejected by score; without an untrusted one, nothing that scores at least as the lowest.

What travels: counts by bucket (``BUCKETS`` rows a task), a histogram of scores, and the
identifiers of trusted documents, which are broadcast if they are few and joined otherwise.

Defined cases: a null text and one without a word have no words and fail the base rules; very
long texts are read whole; ties keep the document; rows that share an identifier are judged
one by one and share its labels; rows of ``labels`` with nulls neither trust nor distrust; an
empty table gives an empty result; columns of any name may be present.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, materialize

BUCKETS = 1 << 14
#: Second factor of a bigram's hash.
MIX = 31_337
MICRO = 1_000_000
CLEAN_WEIGHT = 20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Tokens whose hash a task remembers.
REMEMBERED = 1 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run of ASCII letters, digits and signs beyond ASCII, or a run of other ASCII signs; of UTF-8,
#: in which all bytes of a sign beyond ASCII are above 0x7F.
_TOKEN = re.compile(rb"[a-z0-9\x80-\xFF]+|[^a-z0-9\x80-\xFF\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Hashes(dict):
    """Token to 28 bits of its MD5, remembered up to a bound."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = int.from_bytes(hashlib.md5(token).digest()[:4], "big") >> 4
        self[token] = h
        return h


def buckets_of(text: str | None, known: _Hashes) -> np.ndarray:
    """Bucket of every unigram and bigram of a text's tokens."""
    tokens = _TOKEN.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else []
    h = np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    return np.concatenate([h % BUCKETS, (h[:-1] * MIX + h[1:] + 1) % BUCKETS])


def repeated_words(words: list[str], window: int = 3) -> int:
    """Words covered by windows of ``window`` words that occur twice or more, first ones included."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter(map(known.setdefault, words, range(n)), dtype=np.int64, count=n)
    code = ids[: n - window + 1]
    for i in range(1, window):
        if n ** (i + 1) >= 1 << 63:  # ranks keep the codes of very long texts below 64 bits
            code = np.unique(code, return_inverse=True)[1]
        code = code * n + ids[i : n - window + 1 + i]
    ordered = np.sort(code)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(code, twice)
    covered = np.zeros(n, dtype=bool)
    for i in range(window):
        covered[i : n - window + 1 + i] |= again
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, repeated words)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def trusted(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, good: by identifier, whether all its labels say quality 1 and not toxic."""
    known = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("id")).agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))


def judged(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, fine: by identifier, whether all its labels say quality 1 (the threshold's two sides)."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("id")).agg(F.min((F.col("quality") == 1).cast("int")).alias("fine"))


def with_flags(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``rows`` plus good and fine of their identifier (null: not labelled); whole rows travel only if the labels are many."""
    flags = materialize(trusted(labels).join(judged(labels), "id", "full").select(F.col("id").alias("__id"), "good", "fine"))
    small = F.broadcast(flags) if flags.count() <= BROADCAST_KEYS else flags
    return rows.join(small, F.col(id_col) == F.col("__id"), "left").drop("__id")


def bucket_counts(rows: DataFrame) -> DataFrame:
    """bucket, raw, target: n-gram counts of all rows (text, good) and of the trusted ones."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw, target = _Hashes(), np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)

        def count(some: list[list[np.ndarray]]) -> None:
            for good, own in enumerate(some):
                n = np.bincount(np.concatenate(own), minlength=BUCKETS) if own else 0
                np.add(raw, n, out=raw)
                if good:
                    np.add(target, n, out=target)

        for batch in batches:
            some: list[list[np.ndarray]] = [[], []]  # not trusted, trusted
            size = 0
            for text, good in zip(batch.column(0), batch.column(1).to_pylist()):
                own = buckets_of(text.as_py(), known)
                some[good == 1].append(own)
                size += len(own)
                if size > 1 << 20:
                    count(some)
                    some, size = [[], []], 0
            count(some)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    partial = rows.select("text", "good").mapInArrow(counted, "bucket bigint, raw bigint, target bigint")
    return partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """By bucket: log of smoothed target over raw probability, in whole millionths; 0 where nothing was counted."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    rows = counts.collect()  # BUCKETS rows at most
    raw, target = sum(r["raw"] for r in rows), sum(r["target"] for r in rows)
    if target:
        for r in rows:
            ratio = (r["target"] * raw / target / r["raw"] + 1.0) / 2.0
            out[r["bucket"]] = int(np.floor(np.log(ratio) * MICRO + 0.5))
    return out


def scored(rows: DataFrame, ratios: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` plus the base counts, n_grams and total (sum of the log ratios, in millionths)."""
    shared = rows.sparkSession.sparkContext.broadcast(ratios)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "total"]

    @F.pandas_udf("struct<" + ", ".join(f"{n} bigint" for n in names) + ">")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, by = _Hashes(), shared.value
        for texts in batches:
            out = []
            for text in texts:
                own = buckets_of(text, known)
                out.append((*base_counts(text), len(own), int(by[own].sum())))
            yield pd.DataFrame(out, columns=names)

    return rows.select(*keep, measure("text").alias("__m")).select(*keep, "__m.*")


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat_words) > MAX_REPEAT_PERCENT * F.col(n_words))


def step() -> Column:
    """Score in whole thousandths of a nat an n-gram, rounded down."""
    return F.floor(F.col("total") / (F.col("n_grams") * 1000))


def threshold(scores: DataFrame) -> int | None:
    """Of rows (step, fine): the step from which documents are kept (None: keep all).

    Steps lie between the bucket ratios' bounds, so the histogram has a few thousand rows.
    """
    hist = scores.where("fine IS NOT NULL").groupBy("step").agg(F.sum(F.col("fine").cast("bigint")).alias("fine"), F.sum(1 - F.col("fine").cast("bigint")).alias("poor")).orderBy("step").collect()
    if not sum(r["fine"] for r in hist):
        return None
    errors = sum(r["poor"] for r in hist)  # from the lowest step on, all are kept
    best, at = errors, hist[0]["step"]
    for this, after in zip(hist, hist[1:]):
        errors += CLEAN_WEIGHT * this["fine"] - this["poor"]
        if errors < best:
            best, at = errors, after["step"]
    return int(at)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (struct of ``keep``), base counts, base_failed, n_grams, score (nats), cut (threshold, nats), kept."""
    rows = docs.select(F.struct(*keep).alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = with_flags(rows, labels.select("doc_id", "quality", "toxic"), "id")
    ratios = log_ratios(bucket_counts(rows))
    done = materialize(scored(rows, ratios, ["row", "fine"]).withColumn("base_failed", base_failed()).withColumn("step", F.when(F.col("n_grams") > 0, step())))
    cut = threshold(done.where("NOT base_failed AND step IS NOT NULL").select("step", "fine"))
    good = F.lit(True) if cut is None else F.coalesce(F.col("step") >= cut, F.lit(True))
    return done.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams",
        (F.col("step") / 1000.0).alias("score"), F.lit(None if cut is None else cut / 1000.0).cast("double").alias("cut"), (~F.col("base_failed") & good).alias("kept"),
    )
