"""Snapshot tables: nothing half written is seen, replays change nothing, old versions stay readable."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barflow.sources.snapshots import SnapshotTable

SCHEMA = "symbol string, ts timestamp, v double, n long"
DAY = dt.datetime(2024, 1, 30)


def rows(spark, *items):
    return spark.createDataFrame([(s, DAY + dt.timedelta(days=d), float(v), n) for s, d, v, n in items], SCHEMA)


def values(df):
    return sorted((r["symbol"], (r["ts"] - DAY).days, r["v"]) for r in df.collect())


def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema)


def test_append_upsert_compact(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.versions() == []
    assert t.append(rows(spark, ("A", 0, 1, 1), ("A", 5, 2, 1), ("B", 0, 3, 1)), "one")
    assert not t.append(rows(spark, ("A", 0, 9, 9)), "one")  # a replayed batch
    t.upsert(rows(spark, ("A", 5, 7, 1), ("A", 5, 8, 2), ("C", 0, 4, 1)), ["symbol", "ts"], ["n"])
    assert values(t.read()) == [("A", 0, 1.0), ("A", 5, 8.0), ("B", 0, 3.0), ("C", 0, 4.0)]
    assert values(t.read(0)) == [("A", 0, 1.0), ("A", 5, 2.0), ("B", 0, 3.0)]
    t.append(rows(spark, ("B", 0, 5, 0)))
    report = {(r["symbol"], r["yyyymm"]): (r["rows_before"], r["rows_after"]) for r in t.compact(["symbol", "ts"], ["n"]).collect()}
    assert report[("B", "2024-01")] == (2, 1) and values(t.read())[2] == ("B", 0, 5.0)
    assert t.manifest().select("_batch").distinct().count() == 1
    assert {(r["symbol"], r["yyyymm"]): r["files"] > 0 and r["bytes"] > 0 for r in t.sizes().collect()} == {k: True for k in report}


def test_a_crash_before_the_manifest_leaves_the_old_table(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.append(rows(spark, ("A", 0, 1, 1)))

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(SnapshotTable, "_commit", crash)
    for write in (lambda: t.upsert(rows(spark, ("A", 0, 2, 1)), ["symbol", "ts"]), lambda: t.append(rows(spark, ("Z", 0, 2, 1)), "b"), lambda: t.compact(["symbol", "ts"], ["n"])):
        with pytest.raises(RuntimeError):
            write()
    monkeypatch.undo()
    assert values(t.read()) == [("A", 0, 1.0)] and t.versions() == [0]
    assert t.append(rows(spark, ("Z", 0, 2, 1)), "b") and values(t.read()) == [("A", 0, 1.0), ("Z", 0, 2.0)]


def test_a_manifest_without_its_mark_does_not_count(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(rows(spark, ("A", 0, 1, 1)))
    (tmp_path / "t" / "manifests" / "v=1").mkdir()
    assert t.versions() == [0] and values(t.read()) == [("A", 0, 1.0)]


def test_only_wanted_months_are_opened(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(rows(spark, ("A", 0, 1, 1), ("A", 5, 2, 1), ("A", 40, 3, 1)))
    at = lambda d: F.lit(DAY + dt.timedelta(days=d))
    assert values(t.read(where=t.months(at(3), at(6)))) == [("A", 5, 2.0)]


def test_empty_and_odd_rows(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(spark.createDataFrame([], SCHEMA))
    t.append(spark.createDataFrame([(None, DAY, 1.0, 1), ("a/b=c d", None, 2.0, 1)], SCHEMA))
    assert sorted((r["symbol"] or "", r["v"]) for r in t.read().collect()) == [("", 1.0), ("a/b=c d", 2.0)]
