"""The attention panel as a stream: stateful look-backs, late rows beside it, predictions that mature.

``attention_stream`` keeps for every entity its last 52 closed weeks and the counts of the open
ones.  A week closes when the watermark passes its end; its row is then final and carries the
fields of the batch panel (``panel.attention_fields`` on a grid from the entity's first week).
An event of a closed week is not lost: it comes out of the same stream as a late row.
``to_panel`` splits both into ledger tables, where a replay changes nothing.

``matured`` joins a stream of predictions to a stream of labels; each side is kept no longer
than the horizon and the watermark ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ledger

LOOKBACK, LONG, DENSE, SILENT = 8, 52, 40, 3
DAY_MS = 86_400_000
#: Fields of a closed week; a late row has ``kind`` late, its identifier and time, and none of them.
FIELDS = "week date, att_all bigint, abn_att_all double, att_nonzero_weeks_52 bigint, att_mean_level_52 double, is_initiation boolean, att_zero_base int, sparsity_tier string"


def _sunday(days: np.ndarray) -> np.ndarray:
    """Days since 1970 to the Sunday that ends their week (day 3 was a Sunday)."""
    return days + (3 - days) % 7


def closed_week(past: list[int], n: int) -> tuple:
    """Fields of a week with ``n`` events after the weeks ``past``, the oldest first."""
    short, long = past[-LOOKBACK:], past[-LONG:]
    full = len(short) == LOOKBACK
    abnormal = float(np.log1p(n) - np.mean(np.log1p(short))) if full else None
    base = full and sum(short) == 0
    nonzero = sum(v > 0 for v in long) if long else None
    tier = None if nonzero is None else "dense" if nonzero >= DENSE else "silent" if nonzero <= SILENT else "sparse"
    return n, abnormal, nonzero, float(np.mean(long)) if long else None, n > 0 and base, int(base), tier


def attention_stream(events: DataFrame, entity: str, ts: str, event_id: str, delay: str = "14 days", check_ms: int = 3_600_000) -> DataFrame:
    """kind (week or late), the entity, event_id and ts (of a late row), and the fields of a closed week.

    ``delay`` is how far events may be out of order.  An entity without new events is looked at
    every ``check_ms`` milliseconds, so that its empty weeks close as well.
    """
    kinds = dict(events.dtypes)
    rows = events.select(F.col(entity).alias("entity"), F.col(event_id).alias("event_id"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    rows = rows.withColumn("day", F.unix_date(F.to_date("ts")).cast("int"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto, past, weeks, counts = state.get if state.exists else (None, [], [], [])
        open_, past = dict(zip(weeks, counts)), list(past)
        # The last Sunday whose week had ended when the watermark was taken.
        mark = int(state.getCurrentWatermarkMs() // DAY_MS)
        shut = int(_sunday(np.array([mark]))[0]) - 7
        late = []
        for pdf in batches:
            week = _sunday(pdf["day"].to_numpy())
            gone = week <= shut if upto is None else week <= max(shut, upto)
            late.append(pdf.loc[gone, ["event_id", "ts"]])
            for w, n in zip(*np.unique(week[~gone], return_counts=True)):
                open_[int(w)] = open_.get(int(w), 0) + int(n)
        out = []
        if upto is None and open_:
            upto = min(open_) - 7
        if upto is not None:
            for w in range(upto + 7, shut + 1, 7):
                n = open_.pop(w, 0)
                out.append((np.datetime64(w, "D"), *closed_week(past, n)))
                past = [*past, n][-LONG:]
                upto = w
            state.update((upto, past, list(open_), list(open_.values())))
            state.setTimeoutDuration(check_ms)
        names = [f.split()[0] for f in FIELDS.split(", ")]
        done = pd.DataFrame(out, columns=names).assign(kind="week", entity=key[0], event_id=None, ts=pd.NaT)
        for pdf in [done, *(p.assign(kind="late", entity=key[0], **dict.fromkeys(names)) for p in late)]:
            if len(pdf):
                yield pdf[["kind", "entity", "event_id", "ts", *names]]

    schema = f"kind string, entity {kinds[entity]}, event_id {kinds[event_id]}, ts timestamp, {FIELDS}"
    state = "upto int, past array<bigint>, weeks array<int>, counts array<bigint>"
    return rows.groupBy("entity").applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def to_panel(stream: DataFrame, panel_path: str, late_path: str, checkpoint: str, trigger: dict | None = None):
    """Closed weeks and late rows of ``attention_stream`` into two ledger tables."""

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            ledger.append_missing(spark, rows.where("kind = 'week'").drop("kind", "event_id", "ts"), panel_path, ["entity", "week"])
            ledger.append_missing(spark, rows.where("kind = 'late'").select("entity", "event_id", "ts"), late_path, ["event_id"])
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def matured(predictions: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("as_of", "ticker", "horizon"), horizon: str = "35 days", late: str = "14 days") -> DataFrame:
    """Predictions with their usable labels, as soon as both have arrived.

    ``predictions``: keys, predicted_at; ``labels``: keys, label_available_at, label_status.  A
    label comes within ``horizon`` after its prediction; state older than that is dropped.
    """
    p = predictions.withColumn("predicted_at", F.col("predicted_at").cast("timestamp")).withWatermark("predicted_at", late)
    y = labels.where(F.col("label_status") == "ok").withColumn("label_available_at", F.col("label_available_at").cast("timestamp")).withWatermark("label_available_at", late)
    y = y.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in y.columns if c not in keys])
    on = (F.col("label_available_at") >= F.col("predicted_at")) & (F.col("label_available_at") <= F.col("predicted_at") + F.expr(f"interval {horizon}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return p.join(y, on).drop(*[f"__{k}" for k in keys])
