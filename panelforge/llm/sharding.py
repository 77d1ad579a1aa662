"""Sharding: Feistel permutation with cycle walking over global row numbers (native).

Rows get dense global numbers (hash buckets plus offsets, no global sort).  A keyed
permutation of 0..N-1 maps a row's number to its place in one global shuffle; shard and
slot follow by division, so both can be computed for any row number without data, and
the counts of any two shards differ by at most one (law ``rows``).

Defined cases: null text has size 8 and CRC 0; null and repeated identifiers are
ordinary rows (fully equal rows are interchangeable, and counted before they are spread); an
empty table gives an empty result; very long texts are read by size and CRC only; only the
two named columns are read, so other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_numbers, materialize, numbering_buckets, permute_below


def place(row_number, n_rows: int, n_shards: int, seed: str):
    """(shard, slot) of a global row number, as two columns."""
    p = permute_below(row_number, n_rows, seed)
    return F.pmod(p, F.lit(n_shards)).cast("int"), F.floor(p / n_shards).cast("bigint")


def feistel_shards(docs: DataFrame, n_shards: int = 24, seed: str = "panelforge", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialize(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")))
    n = slim.count()
    numbered = dense_numbers(slim, "row_number", numbering_buckets(n))
    shard, slot = place(F.col("row_number"), max(1, n), n_shards, seed)
    return numbered.withColumns({"shard": shard, "slot": slot})
