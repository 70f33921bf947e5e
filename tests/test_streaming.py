from __future__ import annotations

import os

import pytest

from strataledger.streaming import fold

SF = "/root/testdata/sf0.001"


def txo(spark):
    rows = [(1, 0, 10, 50, 5, True), (2, 0, 20, 150_000, 6, True), (3, 0, 30, None, 7, False), (4, 0, 150_001, 350_000, 8, True), (5, 1, 360_000, None, 9, False)]
    return spark.createDataFrame(rows, "tx_id long, vout int, creation_block int, spent_block int, value long, event boolean")


def test_replay_leaves_the_unspent(spark):
    got = sorted(tuple(r) for r in fold.replay(spark, txo(spark)).collect())
    assert got == [(3, 0, 30, 7), (5, 1, 360_000, 9)]


def test_batches_can_be_run_again_and_unknown_deletes_show(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([(0, "insert", 1, 0, 5, 10), (0, "insert", 2, 0, 5, 20), (0, "insert", 3, 0, 5, 30), (0, "delete", 3, 0, None, None)], fold.OPERATIONS)
    second = spark.createDataFrame([(1, "delete", 1, 0, None, None), (1, "delete", 9, 0, None, None)], fold.OPERATIONS)
    for _ in range(2):
        fold.write_batch(first, 0, path)
        fold.write_batch(second, 1, path)
    entries, failed = fold.ledger(spark, path)
    assert [tuple(r) for r in entries.collect()] == [(2, 0, 5, 20)]
    assert [tuple(r) for r in failed.collect()] == [(9, 0)]
    fold.compact(spark, path, str(tmp_path / "compact"))
    assert [tuple(r) for r in fold.ledger(spark, str(tmp_path / "compact"))[0].collect()] == [(2, 0, 5, 20)]


def test_order_of_arrival_plays_no_part(spark, tmp_path):
    """Parts that arrive late, split within a ledger batch, or twice: operations count by the ledger's batch."""
    rows = [(0, "insert", 1, 0, 5, 10), (0, "insert", 2, 0, 6, 20), (1, "delete", 1, 0, None, None), (1, "insert", 3, 0, 9, 30), (1, "delete", 3, 0, None, None), (2, "insert", 1, 0, 11, 40), (3, "delete", 2, 0, None, None), (4, "insert", 2, 0, 13, 50), (4, "delete", 7, 0, None, None)]
    for n, order in enumerate(([8, 7, 6, 5, 4, 3, 2, 1, 0], [3, 0, 8, 4, 1, 5, 2, 7, 6], range(9))):
        path = str(tmp_path / f"ledger-{n}")
        for part, k in enumerate(order):
            fold.write_batch(spark.createDataFrame([rows[k]], fold.OPERATIONS), part, path)
        fold.write_batch(spark.createDataFrame(rows[:4], fold.OPERATIONS), 99, path)
        entries, failed = fold.ledger(spark, path)
        assert sorted(map(tuple, entries.collect())) == [(1, 0, 11, 40), (2, 0, 13, 50)]
        assert [tuple(r) for r in failed.collect()] == [(7, 0)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_replay_with_one_file_a_task(spark):
    """Without coalescing every batch's files are written by other tasks, and listed in any order."""
    from strataledger.sources.txo import txo as of

    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = of(spark, SF)
        want = sorted(map(tuple, rows.where("NOT event").select("tx_id", "vout", "creation_block", "value").collect()))
        assert sorted(map(tuple, fold.replay(spark, rows, files=1).collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_spends_match_in_either_order(spark, tmp_path):
    from strataledger.streaming.matching import match_spends

    schema = "op string, tx_id long, vout int, height int"
    for k, rows in enumerate(([("insert", 1, 0, 5), ("delete", 2, 0, 9)], [("delete", 1, 0, 8), ("insert", 3, 0, 1)], [("insert", 2, 0, 4), ("delete", 1, 0, 99)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = str(tmp_path / "out")
    match_spends(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("1:0", 5, 8, 3), ("2:0", 4, 9, 5)]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    import datetime as dt

    from strataledger.streaming.matching import windowed_activity

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, event_type string, value double"
    for k, rows in enumerate(([(at(0), "a", 1.0), (at(0, 30), "a", 2.0)], [(at(3), "a", 4.0)], [(at(0, 1), "a", 100.0), (at(5), "b", 1.0)], [(at(9), "b", 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = str(tmp_path / "out")
    windowed_activity(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    got = {(r["start"].hour, r["event_type"]): (r["n"], r["total"]) for r in spark.read.parquet(out).collect()}
    assert got[0, "a"][0] in (2, 3) and got[3, "a"] == (1, 4.0)
