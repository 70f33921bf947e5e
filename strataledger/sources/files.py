"""Readers for history files, raw blocks, block information and benchmark logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataledger.schema import BLOCK_INFO, HISTORY

FILE_STEP = 10_000


def read_history(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """History CSV by position, whatever its header says; only the named columns are parsed."""
    found = spark.read.schema(HISTORY).csv(path, header=True, enforceSchema=True, mode="PERMISSIVE")
    return found.select(*columns) if columns else found


def write_history(history: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """History CSV in files of bounded length; unspent outputs have Unspent and - where a spend would be."""
    history.select(
        "creation_block", F.coalesce(F.col("spent_block").cast("string"), F.lit("Unspent")).alias("spent_block"), "value", "locking_script_size",
        F.coalesce(F.col("unlocking_script_size").cast("string"), F.lit("-")).alias("unlocking_script_size"), "tx_coinbase", "op_return",
    ).write.option("maxRecordsPerFile", rows_per_file).option("header", True).csv(path)


def file_number(path: Column) -> Column:
    """The last number in a file's name, by which files are ordered."""
    return F.regexp_extract(path, r"(\d+)\D*$", 1).try_cast("int")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): the lines of text files with their place.

    A large file is read in blocks by many tasks. Lines are counted by block first; a line's place is its place in its
    block plus the lines of the blocks before, so only a row a block is put in order.
    """
    block = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "block", (before - F.col("first")).alias("shift"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).cast("int").alias("line"), "text")


def hex_bytes(text: Column) -> Column:
    """Bytes of a hex text; an odd length or another character is an error."""
    good = text.rlike("^([0-9A-Fa-f]{2})*$")
    return F.when(good | text.isNull(), F.unhex(text)).otherwise(F.raise_error(F.lit("not a hex text of even length")))


def blocks_of(lines: DataFrame, first: int = 0, count: int | None = None) -> DataFrame:
    """(height, raw) of hex lines (file, line, text), one a block; the file's name holds its first height. Skip and take by height."""
    start = F.regexp_extract("file", r"(\d+)-\d+[^/]*$", 1).cast("int")
    blocks = lines.select((start + F.col("line")).alias("height"), F.trim("text").alias("text")).where(F.col("height") >= first)
    if count is not None:
        blocks = blocks.where(F.col("height") < first + count)
    return blocks.select("height", hex_bytes(F.col("text")).alias("raw"))


def read_raw_blocks(spark: SparkSession, path: str, first: int = 0, count: int | None = None) -> DataFrame:
    """(height, raw): one hex line a block, FILE_STEP blocks a file named by its first height."""
    return blocks_of(read_lines(spark, path), first, count)


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    n = raw[at]
    if n < 0xFD:
        return n, at + 1
    size = {0xFD: 2, 0xFE: 4, 0xFF: 8}[n]
    return int.from_bytes(raw[at + 1 : at + 1 + size], "little"), at + 1 + size


def parse_block(raw: bytes) -> list[tuple]:
    """(tx_index, tx_hash, inputs, outputs) of a serialised block: inputs (tx_hash, index, script), outputs (value, script)."""
    from hashlib import sha256

    n, at = _varint(raw, 80)
    out = []
    for index in range(n):
        begin = at
        at += 4
        n_in, at = _varint(raw, at)
        inputs, outputs = [], []
        for _ in range(n_in):
            prior, vout = raw[at : at + 32], int.from_bytes(raw[at + 32 : at + 36], "little")
            size, at = _varint(raw, at + 36)
            inputs.append((prior, vout, raw[at : at + size]))
            at += size + 4
        n_out, at = _varint(raw, at)
        for _ in range(n_out):
            value = int.from_bytes(raw[at : at + 8], "little")
            size, at = _varint(raw, at + 8)
            outputs.append((value, raw[at : at + size]))
            at += size
        at += 4
        out.append((index, sha256(sha256(raw[begin:at]).digest()).digest(), inputs, outputs))
    return out


TRANSACTION = "height int, tx_index int, tx_hash binary, inputs array<struct<tx_hash:binary,vout:long,script:binary>>, outputs array<struct<value:long,script:binary>>"


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """(height, raw) to a row per transaction; no built-in function reads the format."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (h, k, tx, [{"tx_hash": a, "vout": b, "script": c} for a, b, c in ins], [{"value": a, "script": b} for a, b in outs])
                for h, raw in zip(batch["height"], batch["raw"], strict=True)
                for k, tx, ins, outs in parse_block(raw)
            ]
            yield pd.DataFrame(rows, columns=["height", "tx_index", "tx_hash", "inputs", "outputs"])

    return blocks.mapInPandas(run, TRANSACTION)


def outputs_of(transactions: DataFrame) -> DataFrame:
    """(height, tx_hash, vout, value, script, tx_coinbase, op_return): every output keeps its own index, OP_RETURN or not."""
    from strataledger.functions.scalars import is_op_return

    return transactions.select("height", "tx_hash", (F.col("tx_index") == 0).alias("tx_coinbase"), F.posexplode("outputs").alias("vout", "o")).select(
        "height", "tx_hash", "vout", F.col("o.value").alias("value"), F.col("o.script").alias("script"), "tx_coinbase", is_op_return(F.col("o.script")).alias("op_return")
    )


def inputs_of(transactions: DataFrame) -> DataFrame:
    """(height, spent_hash, spent_vout, script) of every input but the coinbase's, whose outpoint is null."""
    null = F.col("i.vout") == 0xFFFFFFFF
    return transactions.select("height", F.explode("inputs").alias("i")).where(~null).select("height", F.col("i.tx_hash").alias("spent_hash"), F.col("i.vout").cast("int").alias("spent_vout"), F.col("i.script").alias("script"))


def batches_of(blocks: DataFrame, size: int, height: str = "height", n_tx: str = "n_tx") -> DataFrame:
    """blocks with batch: at least size transactions each, rounded up to whole blocks, in height order.

    Where a batch ends depends on where the last one did, so the list of blocks (two numbers a block, fewer than a
    million in all, whatever they hold) passes through one task in order, an Arrow batch at a time.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = held = 0
        for frame in frames:
            out = []
            for n in frame["n"]:
                out.append(batch)
                held += n
                if held >= size:
                    batch, held = batch + 1, 0
            yield pd.DataFrame({"cut_height": frame["cut_height"], "batch": out})

    listed = blocks.select(F.col(height).cast("long").alias("cut_height"), F.col(n_tx).cast("long").alias("n")).repartition(1).sortWithinPartitions("cut_height")  # an exchange of its own, so that what made the list is not one task's
    return blocks.join(listed.mapInPandas(cut, "cut_height long, batch int"), F.col(height) == F.col("cut_height")).drop("cut_height")


def read_block_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_INFO).csv(path, sep=";")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """The log of an ingest benchmark: a row a batch."""
    schema = "batch int, txs double, inputs double, outputs double, time double, tps double, inserts long, deletes long"
    return spark.read.schema(schema).csv(path, header=True)


def first_file_with(lines: DataFrame, text: str = ",Unspent") -> DataFrame:
    """The smallest file number among lines that contain the text."""
    return lines.where(F.contains("text", F.lit(text))).agg(F.min(file_number(F.col("file"))).alias("file_number"))


def csv_to_parquet(spark: SparkSession, source: str, target: str) -> int:
    """History CSV normalised and written as Parquet by epoch; returns the rows written, checked against those read."""
    from strataledger.operators.history import normalise

    normalise(read_history(spark, source)).write.mode("overwrite").partitionBy("epoch").parquet(target)
    written = spark.read.parquet(target).count()  # from the files' footers
    if written != (read := read_history(spark, source, ["creation_block"]).count()):
        raise OSError(f"{written} of {read} rows were written")
    return written
