"""The stateful panel on a shuffled, replayed stream with late rows; predictions that mature."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import timeops as T
from panelforge.operators import ledger, panel
from panelforge.streaming import panel as S
from panelforge.streaming.weekly import to_ledger

EVENTS = "event_id long, ticker string, ts timestamp"
PANEL = ["entity", "week", "att_all", "abn_att_all", "att_nonzero_weeks_52", "att_mean_level_52", "is_initiation", "att_zero_base", "sparsity_tier"]


def plain(r):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in r)


def batch_panel(events, last):
    """The same fields by the batch operators, up to the last closed week."""
    rows = events.withColumn("week", T.week_of(F.col("ts").cast("date")))
    first = rows.groupBy("ticker").agg(F.min("week").alias("a"))
    cells = panel.grid(first, "ticker", "a", F.lit(last))
    counted = panel.counts(rows, ["ticker", "week"], {"att_all": None})
    x = panel.attention_fields(panel.fill_counts(cells, counted, ["ticker", "week"]))
    return sorted(plain(r) for r in x.select(F.col("ticker").alias("entity"), *PANEL[1:]).collect())


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Seventy weeks of four entities in eight files, shuffled within ten days; three events come months late."""
    rng, start = np.random.default_rng(5), dt.datetime(2022, 1, 3)
    rows = []
    for name, rate in (("busy", 4.0), ("some", 0.4), ("rare", 0.05), ("new", 1.5)):
        for d in range(120 if name == "new" else 0, 490):
            rows += [(name, start + dt.timedelta(days=d, seconds=int(s))) for s in rng.integers(0, 86_400, rng.poisson(rate / 7))]
    rows = [(i, *r) for i, r in enumerate(sorted(rows, key=lambda r: r[1]))]
    arrival = sorted(rows, key=lambda r: r[2] + dt.timedelta(days=float(rng.uniform(0, 10))))
    cuts = np.array_split(np.arange(len(arrival)), 8)
    parts = [[arrival[i] for i in c] for c in cuts]
    late = [(10_000 + k, "some", start + dt.timedelta(days=20 + k)) for k in range(3)]
    parts[6] += late
    parts.append([(20_000, "busy", start + dt.timedelta(days=540))])  # moves the watermark on
    folder = str(tmp_path_factory.mktemp("in"))
    for k, p in enumerate(parts):
        spark.createDataFrame(p, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return folder, {i for i, *_ in late}


def run(spark, folder, out, checkpoint):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    q = S.to_panel(S.attention_stream(stream, "ticker", "ts", "event_id", "14 days", check_ms=1), f"{out}/panel", f"{out}/late", checkpoint, {"processingTime": "200 milliseconds"})
    want = dt.date(2023, 6, 4)
    for _ in range(240):
        time.sleep(0.5)
        if q.exception():
            raise q.exception()
        done = ledger.read_or_none(spark, f"{out}/panel")
        if done is not None and done.where(F.col("week") == F.lit(want)).count() == 4:
            break
    q.stop()


def test_stream_equals_batch_with_late_rows_beside(spark, files, tmp_path):
    folder, planted = files
    run(spark, folder, str(tmp_path), str(tmp_path / "cp"))
    late = {r.event_id for r in ledger.read_or_none(spark, str(tmp_path / "late")).collect()}
    assert planted <= late and len(late) < 20
    done = ledger.read_or_none(spark, str(tmp_path / "panel"))
    last = done.agg(F.max("week")).first()[0]
    got = sorted(plain(r) for r in done.where(F.col("week") <= F.lit(last)).select(*PANEL).collect())
    kept = spark.read.schema(EVENTS).parquet(folder).where(~F.col("event_id").isin(*late))
    assert got == batch_panel(kept, last)
    assert {r[-1] for r in got} == {"dense", "sparse", "silent", None}
    # A lost checkpoint replays everything: nothing is written twice.
    n = len(ledger.committed(spark, str(tmp_path / "panel")))
    run(spark, folder, str(tmp_path), str(tmp_path / "cp2"))
    assert ledger.read_or_none(spark, str(tmp_path / "panel")).count() == len(got) and len(ledger.committed(spark, str(tmp_path / "panel"))) == n


def test_closed_week_without_past():
    assert S.closed_week([], 3) == (3, None, None, None, False, 0, None)
    assert S.closed_week([0] * 8, 2)[4:] == (True, 1, "silent")


def test_predictions_mature_when_labels_arrive(spark, tmp_path):
    p, y = str(tmp_path / "p"), str(tmp_path / "y")
    days = [dt.date(2024, 1, 1) + dt.timedelta(7 * k) for k in range(6)]
    preds = spark.createDataFrame([(d, t, "1w", float(k), d) for k, d in enumerate(days) for t in "ab"], "as_of date, ticker string, horizon string, pred double, predicted_at date")
    labels = spark.createDataFrame([(d, t, "1w", 0.5, d + dt.timedelta(6), "ok" if t == "a" or k % 2 else "label_missing") for k, d in enumerate(days) for t in "ab"] + [(days[0], "c", "1w", 0.1, days[1], "ok")], "as_of date, ticker string, horizon string, y double, label_available_at date, label_status string")
    preds.write.parquet(p)
    for k in range(3):
        labels.where(F.col("as_of").isin(days[2 * k : 2 * k + 2])).write.mode("append").parquet(y)
    sp, sy = (spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 2).parquet(f) for x, f in ((preds, p), (labels, y)))
    q = to_ledger(S.matured(sp, sy), str(tmp_path / "scores"), str(tmp_path / "cp"), ["as_of", "ticker", "horizon"])
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, ledger.read_or_none(spark, str(tmp_path / "scores")).select("as_of", "ticker", "pred", "y").collect()))
    want = sorted(map(tuple, ledger.score_mature(preds, labels, dt.date(2030, 1, 1)).select("as_of", "ticker", "pred", "y").collect()))
    assert got == want and len(want) == 9
