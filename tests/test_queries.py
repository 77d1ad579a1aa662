"""Registered queries against their SQL twins in DuckDB, and the streaming forms."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from panelforge.operators import ledger
from panelforge.plans import catalog
from panelforge.streaming.weekly import to_ledger, weekly_counts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A cross-section of the catalogue; the whole is compared at a larger size outside the tests.
CHECKED = ["week_label", "abnormal_attention_weekly", "pit_vs_research_diff", "next_trading_day", "trading_session_count", "sector_peer_attention", "adjusted_prices", "price_validation", "contiguous_lead_returns", "venue_validity", "tercile_by_week", "labels_4w", "folds", "universe_snapshots", "revenue_asof", "news_counts_1w_4w", "weekly_rank_ic", "auc_balanced_accuracy", "backtest_candidates", "title_parse", "roc_date_parse", "number_clean", "html_strip_basic", "ledger_append_guard", "matcher_classes", "title_parser_agreement", "venue_validity_nested", "health_checks", "lead_lag_checks", "matched_event_verdict", "benchmark_buy_hold", "labels_1w_of_panel", "years_covered", "month_gaps", "two_way_fe_models", "ridge_walk_forward_one", "feature_sets"]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    return f"{v:.6g}" if isinstance(v, float) else str(v)[:19].removesuffix(" 00:00:00")


def table(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, sf, name):
    got = table(catalog.queries()[name](spark, sf).toPandas())
    assert got == table(duck.execute(catalog.oracle_sql()[name]).df())
    assert got[1]


@pytest.mark.parametrize("name", ["quantile_portfolio_equal", "portfolio_churn"])
def test_portfolios_need_names(spark, sf, name):
    """Ten suppliers never fill five buckets; the larger fixture does."""
    big = sf.replace("0.001", "0.01")
    c = duckdb.connect()
    for t in ("lineitem", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{big}/{t}.parquet'")
    got = table(catalog.queries()[name](spark, big).toPandas())
    assert got == table(c.execute(catalog.oracle_sql()[name]).df()) and got[1]
    assert catalog.queries()[name](spark, sf).count() == 0


def test_entry_without_training_data_operators():
    assert "abnormal_attention_weekly" in catalog.queries() and not any(re.match(r"op\d", n) for n in catalog.queries())


def test_streaming_weeks_equal_batch(spark, sf, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    q = weekly_counts(stream, "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("weeks").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT event_type, week, n FROM weeks").collect()))
    from panelforge.functions.timeops import week_of

    want = spark.read.parquet(str(src)).groupBy("event_type", week_of(F.col("ts").cast("date")).alias("week")).count()
    assert got == sorted(map(tuple, want.collect()))


def test_stream_into_ledger_twice(spark, sf, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value").write.parquet(str(src))
    for i in range(2):  # a lost checkpoint replays everything
        stream = spark.readStream.schema("event_id long, value double").parquet(str(src))
        q = to_ledger(stream, str(tmp_path / "ledger"), str(tmp_path / f"cp{i}"), ["event_id"])
        q.processAllAvailable()
        q.stop()
    assert ledger.read_or_none(spark, str(tmp_path / "ledger")).count() == spark.read.parquet(str(src)).count()
