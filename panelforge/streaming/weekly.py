"""Structured Streaming forms of the weekly counts and of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger


def weekly_counts(events: DataFrame, ts: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Tumbling Monday-to-Sunday counts, labelled by their Sunday."""
    weeks = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).groupBy(F.window("__ts", "7 days", startTime="4 days").alias("w"), *keys).count()
    return weeks.select(*keys, F.date_sub(F.to_date("w.end"), 1).alias("week"), F.col("count").alias("n"))


def to_ledger(stream: DataFrame, path: str, checkpoint: str, keys: list[str] = ledger.KEYS):
    """Append each micro-batch's new keys; a replayed batch changes nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        ledger.append_missing(batch.sparkSession, batch, path, keys)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
