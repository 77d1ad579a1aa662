"""Raw folders read once, by digest; the benchmark document."""

import json

import pytest
from pyspark.sql import functions as F

from panelforge.operators import ledger
from panelforge.sources import ingest, readers


def put(folder, name, doc):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))


def test_second_run_reads_only_new_files_and_changes_are_found(spark, tmp_path):
    raw, table, cp = tmp_path / "raw", str(tmp_path / "table"), str(tmp_path / "cp")
    put(raw, "2024/a.json", {"id": 1, "name": "x"})
    put(raw, "2024/b.json", {"id": 2, "name": None})
    put(raw, "note.txt", "no json")
    run = lambda c=cp: ingest.ingest(spark, str(raw), table, c, "*.json")
    assert run() == 2 and run() == 0
    put(raw, "2025/c.json", "{broken")
    assert run() == 1
    assert run(str(tmp_path / "other")) == 0  # a lost checkpoint reads again and adds nothing
    got = {r.path.rsplit("/", 1)[1]: (r.doc and r.doc.id, r.corrupt) for r in ingest.documents(spark, table, "id long, name string").collect()}
    assert got["a.json"] == (1, None) and got["b.json"] == (2, None) and got["c.json"][1] == "{broken"
    ingest.verify(spark, str(raw), table, "*.json")
    put(raw, "2024/a.json", {"id": 9})
    (raw / "2024/b.json").unlink()
    assert {r.path.rsplit("/", 1)[1]: r.status for r in ingest.changes(spark, str(raw), table, "*.json").collect()} == {"a.json": "changed", "b.json": "gone"}
    with pytest.raises(ValueError, match="a.json changed"):
        ingest.verify(spark, str(raw), table, "*.json")
    assert ledger.read_or_none(spark, table).count() == 3


def test_empty_table(spark, tmp_path):
    assert ingest.documents(spark, str(tmp_path / "none"), "id long").count() == 0
    assert ingest.changes(spark, str(tmp_path), str(tmp_path / "none")).count() == 0


def test_benchmark_document(spark, tmp_path):
    row = lambda day, o, c: {"date": day, "stock_id": 50, "Trading_Volume": 10, "Trading_money": "1000", "open": o, "max": "12", "min": 0, "close": c}
    put(tmp_path, "b.json", {"data": [row("2024-01-02", 10.0, "11"), row("2024-01-03", "x", 12)]})
    got = sorted(readers.benchmark_prices(spark, str(tmp_path / "b.json")).collect(), key=lambda r: r.date)
    assert [(r.ticker, r.open, r.low, r.close, r.volume, r.adj_open) for r in got] == [("50", 10.0, None, 11.0, 10.0, 10.0), ("50", None, None, 12.0, 10.0, None)]
    events = spark.createDataFrame([("50", "2024-01-03", 0.5), ("50", "2024-01-03", 9.0)], "ticker string, date string, factor double").withColumn("date", F.to_date("date"))
    adjusted = {str(r.date): r.adj_close for r in readers.benchmark_prices(spark, str(tmp_path / "b.json"), events).collect()}
    assert adjusted == {"2024-01-02": 5.5, "2024-01-03": 12.0}
    put(tmp_path, "e.json", {"data": []})
    with pytest.raises(FileNotFoundError):
        readers.benchmark_prices(spark, str(tmp_path / "e.json"))


def test_first_row_of_a_date_stays_in_a_file_read_in_pieces(spark, tmp_path):
    lines = ["Date,Close"] + [f"2024-01-{1 + k % 28:02d},{k}" for k in range(4000)]
    put(tmp_path, "2330.csv", "\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = readers.vendor_csv(spark, str(tmp_path / "2330.csv"))
        got = {str(r.date): (r.ticker, int(r.close)) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == {f"2024-01-{d:02d}": ("2330", d - 1) for d in range(1, 29)}
