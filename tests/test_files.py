from __future__ import annotations

import struct
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from strataledger.operators import history
from strataledger.sources import files

HEADER = "creation_block,spent_block,value,locking_script_size,unlocking_script_size;tx_coinbase;op_return\n"


def test_history_is_read_by_position_and_normalised(spark, tmp_path):
    (tmp_path / "history-7.csv").write_text(HEADER + "100,120,5000,25,107,True,false\n100,Unspent,7,40000,-,false,TRUE\n200,210,1,25,,false,false\n")
    got = {r["value"]: r.asDict() for r in history.normalise(files.read_history(spark, str(tmp_path))).collect()}
    assert got[5000]["duration"] == 20 and got[5000]["event"] and got[5000]["tx_coinbase"] and got[5000]["unlocking_script_size"] == 107
    assert got[7]["spent_block"] is None and got[7]["duration"] == 789_899 and got[7]["op_return"] and got[7]["locking_script_size"] == 40_000 and got[7]["unlocking_script_size"] == 0
    assert got[1]["unlocking_script_size"] == -1 and got[1]["epoch"] == 0


def test_history_round_trip_in_bounded_files(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("int").alias("creation_block"), F.when(F.col("id") % 2 == 0, F.col("id") + 1).cast("int").alias("spent_block"), F.col("id").alias("value"), F.lit(25).alias("locking_script_size"), F.lit(None).cast("int").alias("unlocking_script_size"), F.lit(True).alias("tx_coinbase"), F.lit(False).alias("op_return"))
    files.write_history(rows.coalesce(1), str(tmp_path / "h"), rows_per_file=30)
    assert len(list((tmp_path / "h").glob("*.csv"))) == 4
    back = history.normalise(files.read_history(spark, str(tmp_path / "h")))
    assert back.count() == 100 and back.where("event").count() == 50


def test_repairs(spark):
    lines = spark.createDataFrame([("100,5000,Unspent,25,x",), ("100,120,5000,25,107",), ("1,2,3",), ("100,Unspent,5000,25,-false,true",)], "line string")
    got = [tuple(r) for r in lines.select(history.repair_five(F.col("line")), history.repair_six(F.col("line"))).collect()]
    assert got[0][0] == "100,Unspent,5000,25,-" and got[1][0] == "100,120,5000,25,107" and got[2][0] is None and got[3] == (None, "100,Unspent,5000,25,,false,true")
    parsed = lines.select(history.repair_six(F.col("line")).alias("line")).where("line LIKE '%true'").select(*history.parse_line(F.col("line"))).first()
    assert parsed["spent_block"] is None and parsed["value"] == 5000 and parsed["op_return"] is True


def _block():
    """A coinbase with two outputs (the first OP_RETURN) and a transaction that spends the second."""

    def tx(inputs, outputs):
        raw = struct.pack("<i", 1) + bytes([len(inputs)])
        for prior, vout, script in inputs:
            raw += prior + struct.pack("<I", vout) + bytes([len(script)]) + script + b"\xff" * 4
        raw += bytes([len(outputs)])
        for value, script in outputs:
            raw += struct.pack("<q", value) + bytes([len(script)]) + script
        return raw + struct.pack("<I", 0)

    coinbase = tx([(b"\0" * 32, 0xFFFFFFFF, b"cb")], [(0, b"\x6a\x01x"), (50, b"\x76\xa9")])
    key = sha256(sha256(coinbase).digest()).digest()
    return b"\0" * 80 + b"\x02" + coinbase + tx([(key, 1, b"sig")], [(49, b"\x76")]), key


def test_raw_blocks(spark, tmp_path):
    raw, key = _block()
    (tmp_path / "block-raw-10000-20000.csv").write_text(raw.hex() + "\n" + raw.hex() + "\n" + raw.hex() + "\n")
    blocks = files.read_raw_blocks(spark, str(tmp_path), first=10_001, count=1)
    assert [r["height"] for r in blocks.collect()] == [10_001]
    txs = files.parse_blocks(blocks)
    outputs = {(bytes(r["tx_hash"]), r["vout"]): r for r in files.outputs_of(txs).collect()}
    assert len(outputs) == 3 and outputs[key, 0]["op_return"] and outputs[key, 0]["tx_coinbase"]
    assert outputs[key, 1]["value"] == 50 and not outputs[key, 1]["op_return"]  # the index goes on after OP_RETURN
    inputs = files.inputs_of(txs).collect()
    assert [(bytes(r["spent_hash"]), r["spent_vout"]) for r in inputs] == [(key, 1)]


def test_bad_hex_is_an_error(spark):
    for text in ("abc", "zz"):
        with pytest.raises(Exception, match="hex"):
            spark.createDataFrame([(text,)], "t string").select(files.hex_bytes(F.col("t"))).collect()


def test_batches_are_whole_blocks(spark):
    counts = [3, 4, 10, 1, 1, 9, 2]
    got = {r["height"]: r["batch"] for r in files.batches_of(spark.createDataFrame(list(enumerate(counts)), "height int, n_tx int"), 7).collect()}
    batch = held = 0
    for height, n in enumerate(counts):
        assert got[height] == batch
        held += n
        if held >= 7:
            batch, held = batch + 1, 0


def test_other_files(spark, tmp_path):
    (tmp_path / "block-info-0-2.csv").write_text("0;aa;285;1231006505;1231006505;1\n")
    assert files.read_block_info(spark, str(tmp_path / "block-info-0-2.csv")).first()["n_tx"] == 1
    (tmp_path / "bench.csv").write_text("batch,txs,inputs,outputs,time,tps,inserts,deletes\n1,2.0,1.5,3.5,10.1,198,5,6\n")
    assert files.read_benchmark(spark, str(tmp_path / "bench.csv")).first()["deletes"] == 6
    d = tmp_path / "hist"
    d.mkdir()
    for n, text in ((9, "1,2,3"), (12, "1,Unspent,3"), (40, "2,Unspent,3")):
        (d / f"history-{n}.csv").write_text(text + "\n")
    assert files.first_file_with(files.read_lines(spark, str(d))).first()[0] == 12


def test_lines_of_a_file_read_in_blocks_keep_their_places(spark, tmp_path):
    for start, n in ((0, 400), (10_000, 70)):
        (tmp_path / f"block-raw-{start}-{start + 9_999}.csv").write_text("".join(f"{(start + k) * 31:08x}\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")  # some fifty lines a block
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = {r["height"]: r["raw"] for r in files.read_raw_blocks(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {h: int(raw.hex(), 16) for h, raw in got.items()} == {h: h * 31 for h in (*range(400), *range(10_000, 10_070))}


def test_logger_writes_a_line(tmp_path):
    from strataledger.log import logger

    logger("strataledger.test", str(tmp_path / "log")).info("batch %d", 7)
    assert (tmp_path / "log").read_text().rstrip().endswith("batch 7")
