"""Commits of the ledger: one winner, whole batches, each score once."""

import threading

import pytest
from pyspark.sql import functions as F

from panelforge.operators import ledger

SCHEMA = "as_of int, ticker string, pred double"


def batch(spark, pairs, pred=0.0):
    return spark.createDataFrame([(a, t, pred) for a, t in pairs], SCHEMA)


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    """Both pass their check before either commits: the second sees the first's batch and fails whole."""
    path, start = str(tmp_path / "t"), threading.Barrier(2)
    plain, met = ledger.conflicts, threading.local()

    def slow(new, old, keys):
        out = plain(new, old, keys)
        out.isEmpty()
        if not getattr(met, "once", False):
            met.once = True
            start.wait(60)
        return out

    monkeypatch.setattr(ledger, "conflicts", slow)
    said = {}

    def write(name, pairs, pred):
        try:
            ledger.append_immutable(spark, batch(spark, pairs, pred), path, ["as_of", "ticker"])
            said[name] = "ok"
        except ValueError:
            said[name] = "refused"

    threads = [threading.Thread(target=write, args=a) for a in (("one", [(1, "a"), (2, "a")], 1.0), ("two", [(2, "a"), (3, "a")], 2.0))]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert sorted(said.values()) == ["ok", "refused"]
    kept = ledger.read_or_none(spark, path).collect()
    assert len(kept) == 2 and len({r.pred for r in kept}) == 1  # no half batch


def test_writers_of_different_keys_both_get_in(spark, tmp_path):
    path = str(tmp_path / "t")
    threads = [threading.Thread(target=ledger.append_immutable, args=(spark, batch(spark, [(k, "a")]), path, ["as_of", "ticker"])) for k in range(4)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert sorted(r.as_of for r in ledger.read_or_none(spark, path).collect()) == [0, 1, 2, 3]
    assert [v for v, _ in ledger.committed(spark, path)] == [1, 2, 3, 4]


def test_uncommitted_batches_are_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    ledger.append_immutable(spark, batch(spark, [(1, "a")]), path, ["as_of", "ticker"])

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(ledger, "_create", crash)
    with pytest.raises(OSError):
        ledger.append_immutable(spark, batch(spark, [(2, "a")]), path, ["as_of", "ticker"])
    monkeypatch.undo()
    assert ledger.read_or_none(spark, path).count() == 1
    ledger.append_immutable(spark, batch(spark, [(2, "a")]), path, ["as_of", "ticker"])
    assert ledger.read_or_none(spark, path).count() == 2


def test_append_missing_with_maps_ties_and_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, {"a": 2}), (1, {"a": 1}), (2, {})], "k int, m map<string,int>")
    ledger.append_missing(spark, rows, path, ["k"])
    ledger.append_missing(spark, rows.where("k = 2"), path, ["k"])
    ledger.append_missing(spark, rows.where("false"), path, ["k"])
    got = {r.k: r.m for r in ledger.read_or_none(spark, path).collect()}
    assert got == {1: {"a": 1}, 2: {}} and len(ledger.committed(spark, path)) == 1
    assert ledger.read_or_none(spark, str(tmp_path / "none")) is None
    ledger.append_missing(spark, rows.where("k = 2").withColumn("k", F.lit(3)), path, ["k"])
    assert ledger.read_or_none(spark, path).count() == 3
