"""Exact dedup: tree-merge of sorted digest runs (native).

Every input partition is a run: its rows' digests, sorted, equal ones collapsed.  Runs are
merged in binomial rounds, ``fan_in`` at a time: run ``r`` goes to run ``r // fan_in``.  A
merge keeps, per digest, the row with the smallest identifier and the number of rows.  Run
and digest together are the key of a round, so a merge is spread over all tasks, a
digest that fills a third of the table meets at most ``fan_in`` rows of itself per
round, and no task ever sees a whole group of copies.  The decisions travel back down
the same tree to the rows.

The order is that of Spark's sort-based aggregate: a round exchanges (run, digest), the
sort of the receiving task brings the segments of its child runs into one order (an
external merge sort; there is no separate k-way heap), and one pass over that order
collapses equal neighbours and writes the parent run sorted.

Verified: rows are equal only if SHA-256, byte length and an independent 64-bit hash
of the normalised text all agree; every round compares all three.

Defined cases: a null text is the empty text; a null identifier is larger than any
other; of rows that repeat an identifier exactly one stays (the first written); very long
texts are hashed whole; an empty table gives an empty result; columns of any name may be
present.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_WS, drop_keys, materialize

KEY = ["digest", "n_bytes", "check"]


def normalised(text) -> "F.Column":
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_WS, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: seq, id, run and the verified digest key; no text."""
    norm = docs.select(F.col(id_col).cast("bigint").alias("id"), normalised(F.col(text_col)).alias("norm"), F.monotonically_increasing_id().alias("seq"), F.spark_partition_id().cast("bigint").alias("run"))
    return norm.select("seq", "id", "run", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").alias("n_bytes"), F.xxhash64(F.lit(7), "norm").alias("check"))


def merge_tree(runs: DataFrame, fan_in: int = 8) -> DataFrame:
    """(run, KEY, best, size) of level 0 -> for its duplicates (run, KEY, keep, size)."""
    levels = [runs]
    while (levels[-1].agg(F.max("run")).first()[0] or 0) > 0:
        up = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in)).groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        levels.append(materialize(up))
    down = levels[-1].where("size > 1").select("run", *KEY, F.col("best").alias("keep"), "size")
    for level in reversed(levels[:-1]):
        child = level.select(F.col("run").alias("child"), F.floor(F.col("run") / fan_in).alias("run"), *KEY)
        down = child.join(down, ["run", *KEY]).select(F.col("child").alias("run"), *KEY, "keep", "size")
    return down


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, seq, KEY."""
    base = materialize(digests(docs, id_col, text_col))
    best = F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("sort_id"), F.col("seq").alias("seq"), F.col("id").alias("id"))
    runs = materialize(base.sortWithinPartitions("run", *KEY).groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size")))
    found = merge_tree(runs, fan_in)
    out = base.join(found, ["run", *KEY], "left")
    single = F.col("keep").isNull()
    return out.select(
        F.col("id"),
        F.when(single, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (single | (F.col("keep.seq") == F.col("seq"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "seq",
        *KEY,
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """``docs`` without its exact copies: all columns, one row of each group of equal texts.

    Decisions are keyed by identifier and digest; only the keys of dropped rows travel
    (``drop_keys``).  Of rows that repeat an identifier and a text, one stays.
    """
    said = exact_dedup(docs, id_col, text_col, fan_in).where("group_size > 1").groupBy("id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    said = materialize(said)
    rows = docs.select(F.struct("*").alias("row"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.select("row", F.col(f"row.{id_col}").cast("bigint").alias("id"), F.unhex(F.sha2("norm", 256)).alias("digest"))
    return drop_keys(rows, ["id", "digest"], said.where("NOT kept"), said.where("kept AND n > 1")).select("row.*")
