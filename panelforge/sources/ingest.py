"""Resumable ingest of raw folders: each file once, by digest, into an append-only table.

A streaming file source lists a folder and remembers in its checkpoint what it has read, so a
second run reads only new files, and a run that was interrupted goes on where it stopped.  Each
file becomes a row (path, bytes, SHA-256, content) of a ledger table, where a replayed batch
changes nothing.  What was read is fixed: ``verify`` hashes the folder again and fails on a file
whose content is not that of its row, and on one that is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, pattern: str = "*", files_per_batch: int = 1000) -> int:
    """Files that are new since the last run, into ``table``; how many rows were added."""
    before = _count(spark, table)
    stream = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    rows = stream.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")

    def sink(batch: DataFrame, _: int) -> None:
        ledger.append_missing(batch.sparkSession, batch, table, ["path"])

    q = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return _count(spark, table) - before


def _count(spark: SparkSession, table: str) -> int:
    rows = ledger.read_or_none(spark, table)
    return 0 if rows is None else rows.count()


def changes(spark: SparkSession, folder: str, table: str, pattern: str = "*") -> DataFrame:
    """path, status (changed or gone) of ingested files that are not what they were."""
    kept = ledger.read_or_none(spark, table)
    if kept is None:
        return spark.createDataFrame([], "path string, status string")
    now = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", F.sha2("content", 256).alias("__now"))
    status = F.when(F.col("__now").isNull(), "gone").when(F.col("__now") != F.col("sha256"), "changed")
    return kept.select("path", "sha256").join(now, "path", "left").select("path", status.alias("status")).where("status IS NOT NULL")


def verify(spark: SparkSession, folder: str, table: str, pattern: str = "*") -> None:
    """Fail if an ingested file has changed or is gone; the message names some of them."""
    bad = changes(spark, folder, table, pattern).orderBy("path").limit(5).collect()
    if bad:
        raise ValueError("ingested files differ: " + "; ".join(f"{r['path']} {r['status']}" for r in bad))


def documents(spark: SparkSession, table: str, schema: str, corrupt: str = "corrupt") -> DataFrame:
    """path and the parsed JSON of every ingested file; ``corrupt`` holds the text of one that does not parse."""
    rows = ledger.read_or_none(spark, table)
    if rows is None:
        return spark.createDataFrame([], f"path string, doc struct<{schema}>, {corrupt} string")
    text = F.col("content").cast("string")
    doc = F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return rows.select("path", doc.alias("doc")).select("path", F.col("doc").dropFields("_corrupt").alias("doc"), F.col("doc._corrupt").alias(corrupt))
