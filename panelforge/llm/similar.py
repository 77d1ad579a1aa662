"""Links between texts whose word shingles overlap by a given share.

A two-bit SimHash distance only reaches similarities near 1 (see the README), so the
near-dedup of documents adds these links to operator 1's.  Candidates share one of
``BANDS`` bands of ``ROWS`` min-hashes.  The min-hashes only rule out pairs that agree on
less than ``similarity`` - ``SLACK`` of them; the others are decided by the exact Jaccard
similarity of their sets of shingle hashes (64 bits).

Every pair of a bucket ends up connected by links or compared.  First each document meets
the smallest and the largest of its bucket, two comparisons a document.  Where more than
one component is left in a bucket of more than three, the documents outside its largest
component (the askers) then meet all documents of the bucket, linked ones too: a document
that is linked to a representative may still connect one that is not.  Askers and bucket
are dealt in blocks over cells, a task holds one cell at a time and gives a spanning
forest.  So a group of near copies costs its outliers times its size; only a bucket of many
documents unlike one another costs the square of its size, in min-hash comparisons.

A pair of Jaccard similarity 0.8 shares a band with probability 0.99994, and agrees on
less than 0.65 of the min-hashes with probability below 1e-6.

Defined cases: texts without a word have no links here; fewer words than a shingle make
one shingle; repeated rows link to themselves only; rows without an identifier have no
links; an empty table gives no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, materialize, may_hold, spread_join

BANDS, ROWS = 32, 6
#: What the estimate of a pair may lack before the pair is ruled out: five standard errors at 0.8.
SLACK = 0.15
#: Documents and shingles of a block of a bucket, in the mean.
BLOCK, BLOCK_SHINGLES = 512, 2**20
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray | None:
    """The sorted set of hashes (64 bits) of the word shingles of a whole text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return None
    digest = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - words + 1)
    return np.unique(np.fromiter((digest(b" ".join(tokens[i : i + words])) for i in range(n)), np.uint64, n))


def signature(hashes: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """Min-hashes (32 bits each) of a set of shingle hashes."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint64)
    for at in range(0, len(hashes), chunk):
        mixed = (hashes[at : at + chunk, None] * _MUL + _ADD) >> np.uint64(32)
        np.minimum(least, mixed.min(axis=0), out=least)
    return least.astype("<u4")


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, size (of the set), sig (binary), bands (one hash per band); rows without a word are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, sigs, bands = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                hashes = shingles(t.as_py(), words)
                if hashes is not None:
                    s = signature(hashes)
                    ids.append(i)
                    sizes.append(len(hashes))
                    sigs.append(s.tobytes())
                    bands.append([xxhash.xxh64_intdigest(s[k * ROWS : (k + 1) * ROWS].tobytes(), k) - 2**63 for k in range(BANDS)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "size", "sig", "bands"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, size long, sig binary, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, hashes (binary: the sorted shingle hashes) of the documents named in ``ids`` (distinct); other texts hardly travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.astype("<u8").tobytes() if s is not None else None for s in sets], pa.binary())], ["id", "hashes"])

    named = may_hold(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), ids, "id").join(ids, "id", "left_semi")
    return named.mapInArrow(run, "id long, hashes binary").where("hashes IS NOT NULL").dropDuplicates(["id"])


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    small, big = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < similarity * len(big):
        return False
    common = int((big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small).sum())
    return common >= similarity * (len(a) + len(b) - common)


@F.pandas_udf(T.DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal min-hashes: the estimated Jaccard similarity."""
    return pd.Series([float(np.mean(np.frombuffer(x, "<u4") == np.frombuffer(y, "<u4"))) for x, y in zip(a, b)], dtype="float64")


def cell_links(similarity: float):
    """For mapInArrow: rows sorted by cell -> links between its askers and its other rows."""
    least = int(np.ceil((similarity - SLACK) * BANDS * ROWS - 1e-9))

    def links(k: int, askers: list[tuple], rows: list[tuple]) -> Iterator[tuple[int, int]]:
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        sigs = np.stack([np.frombuffer(r[3], "<u4") for r in rows])
        for i, comp, _, sig, hashes in askers:
            sig, own = np.frombuffer(sig, "<u4"), np.frombuffer(hashes, "<u8")
            equal = sigs == sig
            for at in np.flatnonzero(equal.sum(axis=1) >= least):
                j, other, asks, _, theirs = rows[at]
                # Two askers meet in two cells, and in every band they share: one is enough.
                if (asks and j <= i) or root(comp) == root(other) or equal[at].reshape(BANDS, ROWS).all(axis=1).argmax() != k:
                    continue
                if alike(own, np.frombuffer(theirs, "<u8"), similarity):
                    parent[root(comp)] = root(other)
                    yield i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, askers, rows, out = None, [], [], []

        def close() -> None:
            if askers and rows:
                out.extend(links(cell[3], askers, rows))
            askers.clear(), rows.clear()

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], pa.int64()) for n in (0, 1)], ["a", "b"])
            out.clear()
            return made

        for b in batches:
            for band, i, j, k, role, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (band, i, j, k) != cell:
                    close()
                    cell = band, i, j, k
                (askers if role else rows).append(tuple(row))
            if len(out) > 50_000:
                yield batch()
        close()
        yield batch()

    return run


def open_links(crowd: DataFrame, linked: DataFrame, sigs: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (a, b) inside the buckets of ``crowd`` (band, k, id, size) that ``linked`` (a, b) leaves in parts."""
    label = components(linked).select(F.col("node").alias("id"), "component")
    parted = materialize(crowd.join(label, "id", "left").withColumn("component", F.coalesce("component", "id")))
    parts = parted.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "component", "size"))
    parts = parts.groupBy("band").agg(F.sum("n").alias("n"), F.sum("size").alias("all"), most.alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    parts = parts.select("band", F.col("most.component").alias("main"), blocks(F.col("n"), F.col("all")).alias("nj"), blocks(F.col("n") - F.col("most.n"), F.col("all") - F.col("most.size")).alias("ni"))
    parts = parts.join(crowd.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "band")
    rows = spread_join(parted.drop("size"), parts, "band", crowd.count(), "id").withColumn("asks", F.col("component") != F.col("main"))
    rows = rows.join(sigs.select("id", "sig"), "id").join(sets, "id")
    i, j = F.pmod(F.xxhash64("id"), "ni").cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), "nj").cast("int")
    cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    met = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda x: cell(x, j, False))
    asked = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda x: cell(i, x, True))).otherwise(F.array().cast("array<struct<i:int,j:int,role:boolean>>"))
    rows = rows.withColumn("cell", F.explode(F.concat(met, asked))).select("band", "cell.i", "cell.j", "k", "cell.role", "id", "component", "asks", "sig", "hashes")
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "role", "id").mapInArrow(cell_links(similarity), "a long, b long")


def both_ends(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """``pairs`` (a, b) with ``value`` of both documents; one that is in many pairs is dealt over parts."""
    total = pairs.count()
    for end, other in ("ab", "ba"):
        n = pairs.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        own = values.select("id", value).join(n, "id").dropDuplicates(["id"]).select(F.col("id").alias(end), F.col(value).alias(f"{value}_{end}"), "n")
        pairs = spread_join(pairs, own, end, total, other)
    return pairs


def similar_links(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all candidates whose texts' shingle similarity is at least ``similarity``."""

    @F.pandas_udf(T.BooleanType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), similarity) for x, y in zip(a, b)], dtype="bool")

    sigs = materialize(signatures(docs, words, id_col, text_col))
    band = sigs.select("id", "size", F.posexplode("bands").alias("k", "band"))
    buckets = band.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    met = materialize(spread_join(band, buckets.withColumn("members", F.col("n")), "band", BANDS * sigs.count(), "id"))
    crowd = materialize(met.where("members > 3").select("band", "k", "id", "size").distinct())
    pairs = met.select("id", F.explode(F.array("low", "high")).alias("other")).where("id != other")
    pairs = materialize(pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct())
    close = materialize(both_ends(pairs, sigs, "sig").where(agreement("sig_a", "sig_b") >= similarity - SLACK).select("a", "b"))
    named = materialize(close.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowd.select("id")).distinct())
    sets = materialize(shingle_sets(docs, named, words, id_col, text_col))
    linked = materialize(both_ends(close, sets, "hashes").where(similar("hashes_a", "hashes_b")).select("a", "b"))
    one_each = sigs.join(crowd.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    return linked.unionByName(open_links(crowd, linked, one_each, sets, similarity, block))
