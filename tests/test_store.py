from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from strataledger.operators import report
from strataledger.operators.store import ENTRY, Store

SF = "/root/testdata/sf0.001"


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def keys(spark, *ks):
    return spark.createDataFrame([(k, 0) for k in ks], "tx_id long, vout int")


def held(store):
    return sorted((r["tx_id"], r["value"]) for r in store.entries().collect())


def test_insert_find_erase(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert store.count() == 0
    store.insert(entries(spark, (1, 0, 12345, 7, 15)))
    store.find(keys(spark, 1, 2))
    found, missing = store.drain_lookups()
    assert [r["value"] for r in found.collect()] == [7] and [r["tx_id"] for r in missing.collect()] == [2]
    store.erase(keys(spark, 1))
    assert store.count() == 1  # waits
    done, failed = store.drain()
    assert done == 1 and failed.count() == 0 and store.count() == 0


def test_deletes_of_unknown_and_repeated_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.insert(entries(spark, (1, 0, 1, 1, 1), (2, 0, 1, 2, 1)))
    store.erase(keys(spark, 2, 9))
    store.erase(keys(spark, 2))
    done, failed = store.drain()
    assert done == 1 and [r["tx_id"] for r in failed.collect()] == [9] and held(store) == [(1, 1)]
    assert store.drain()[0] == 0


def test_first_entry_stays_and_a_deleted_key_can_come_back(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.insert(entries(spark, (1, 0, 1, 10, 1)))
    store.insert(entries(spark, (1, 0, 2, 20, 1)))
    assert held(store) == [(1, 10)]
    store.apply(entries(spark, (5, 0, 3, 50, 1)), keys(spark, 1, 5))
    assert held(store) == []
    store.insert(entries(spark, (1, 0, 4, 30, 1)))
    assert held(store) == [(1, 30)]


def test_compaction_reopening_and_copying(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    for k in range(3):
        store.apply(entries(spark, (k, 0, k, k, 40 + k), (10 + k, 0, k, k, 200)), keys(spark, k - 1) if k else keys(spark, 99))
    before, batches = held(store), store.batches()
    store.compact()
    assert held(store) == before and len(store.batches()) == 1 < len(batches)
    again = Store(spark, str(tmp_path / "db"))
    again.insert(entries(spark, (77, 0, 9, 9, 10_000)))
    assert held(again) == sorted([*before, (77, 9)])
    stats = {r["container"]: r["n"] for r in again.statistics().collect()}
    assert sum(stats.values()) == again.count() and stats[3] == 1
    assert again.entries_where(F.col("value") > 8).count() == 1
    other = Store(spark, str(tmp_path / "other"))
    assert again.copy_to(other) == again.count() and held(other) == held(again)
    assert Store(spark, str(tmp_path / "db"), remove_existing=True).count() == 0


def test_rotation_skipping_and_counters(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), rows_per_file=100)
    rows = spark.range(1000).selectExpr("id AS tx_id", "0 AS vout", "1 AS height", "id AS value", "CAST(id % 200 AS INT) AS size")
    assert store.insert(rows.coalesce(1)) == 1000
    files = store.files().collect()
    assert len(files) == 10 and all(r["n"] == 100 and r["max_key"] - r["min_key"] == 99 for r in files)
    wanted = keys(spark, 250, 251, 5000)
    plan = store.entries_of(keys(spark, 250, 251))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(tx_id,250)" in plan and "LessThanOrEqual(tx_id,251)" in plan  # what files are skipped by
    store.find(wanted)
    found, missing = store.drain_lookups()
    assert sorted(r["value"] for r in found.collect()) == [250, 251] and [r["tx_id"] for r in missing.collect()] == [5000]
    store.erase(wanted)
    store.erase(keys(spark, 250))
    assert store.drain()[0] == 2
    assert store.counters == {"inserts": 1000, "deletes": 2, "failed_deletes": 1, "deferred_deletes": 3, "longest_queue_deletes": 3, "deferred_lookups": 3, "longest_queue_lookups": 3}
    store.compact()
    assert store.count() == 998 and store.entries_of(keys(spark, 7777)).count() == 0 and store.entries_of(keys(spark)).count() == 0


def test_a_long_table_tells_what_it_leaves_out(spark, monkeypatch):
    monkeypatch.setattr(report, "MOST", 3)
    assert report.section("t", spark.range(10), "id").endswith("... and 7 more rows\n") and "more" not in report.section("t", spark.range(3), "id")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_report(spark, tmp_path):
    from strataledger.sources.txo import txo

    text = report.ledger_report(txo(spark, SF))
    report.write(str(tmp_path / "r.txt"), text)
    assert "n_spent: 3,185" in (tmp_path / "r.txt").read_text() and "Segments" in text
    assert report.labelled((0, 10, float("inf")), True) == ["(0, 10]", "(10, inf]"] and report.labelled((0, 10), False) == ["[0, 10)"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_replay_and_timed_lookups(spark, tmp_path):
    from strataledger.operators import ingest
    from strataledger.operators.state import lookup_workload
    from strataledger.sources.txo import txo

    rows = txo(spark, SF).cache()
    store = Store(spark, str(tmp_path / "db"))
    done = ingest.replay(store, rows, blocks=250_000, compact_every=2)
    assert store.count() == rows.where("NOT event").count() and done[-1].total_inserts - done[-1].total_deletes == store.count()
    assert ingest.as_dicts(done)[-1]["rate"] > 0 and ingest.batches_table(store, done).count() == len(done)
    half = Store(spark, str(tmp_path / "half"))
    ingest.replay(half, rows.where("creation_block < 300000").selectExpr("tx_id", "vout", "creation_block", "CASE WHEN spent_block < 300000 THEN spent_block END AS spent_block", "value", "locking_script_size"), blocks=300_000)
    got = ingest.timed_lookups(half, lookup_workload(rows, 300_000, 400_000, misses=1), [1, 3], repeats=1).collect()
    assert all(r["unexpected"] == 0 and r["found"] > 0 for r in got)
    with pytest.raises(RuntimeError, match="unknown keys"):
        ingest.replay(Store(spark, str(tmp_path / "bad")), rows.where("creation_block >= 300000").selectExpr("tx_id", "vout", "creation_block", "CAST(0 AS INT) AS spent_block", "value", "locking_script_size"), blocks=300_000)
    rows.unpersist()
