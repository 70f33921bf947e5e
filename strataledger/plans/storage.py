"""Queries that write files or a store in the shared folder and read them back: readers, sinks, the store's operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataledger.functions import scalars
from strataledger.operators import ingest, survival
from strataledger.operators.store import Store
from strataledger.plans.learning import _KM
from strataledger.plans.ledger import _LAID, _TOTALS, _WANTED, BATCH, _wanted
from strataledger.plans.registry import register
from strataledger.session import shared_folder
from strataledger.sources import files
from strataledger.sources.txo import txo


def _entries(spark, sf_dir):
    return txo(spark, sf_dir).select("tx_id", "vout", F.col("creation_block").alias("height"), "value", F.col("locking_script_size").alias("size"))


def _filled(spark, sf_dir):
    store = Store(spark, shared_folder(spark, "store"), rows_per_file=100_000)
    store.insert(_entries(spark, sf_dir).repartitionByRange("tx_id", "vout"))
    return store


@register("store_replay", "SELECT tx_id, vout, creation_block AS height, value, locking_script_size AS size FROM txo WHERE NOT event")
def store_replay(spark, sf_dir):
    """A store's entries after a history was replayed into it, batch by batch, with compactions on the way."""
    store = Store(spark, shared_folder(spark, "store"))
    ingest.replay(store, txo(spark, sf_dir), 2 * BATCH, compact_every=3)
    return store.entries().drop("batch")


@register("store_lookups", f"{_WANTED} SELECT DISTINCT w.tx_id, w.vout, t.creation_block AS height, t.value, t.tx_id IS NOT NULL AS found FROM w LEFT JOIN txo t ON w.tx_id = t.tx_id AND w.vout = t.vout")
def store_lookups(spark, sf_dir):
    """Lookups asked of a store and answered together: those found, and those that failed."""
    store = _filled(spark, sf_dir)
    store.find(_wanted(spark, sf_dir))
    found, missing = store.drain_lookups()
    nothing = [F.lit(None).cast("int").alias("height"), F.lit(None).cast("long").alias("value"), F.lit(False).alias("found")]
    return found.select("tx_id", "vout", "height", "value", F.lit(True).alias("found")).unionAll(missing.select("tx_id", "vout", *nothing))


@register("store_erase", f"{_WANTED}, d AS (SELECT DISTINCT tx_id, vout FROM w) SELECT (SELECT count(*) FROM txo) AS inserts, (SELECT count(*) FROM d SEMI JOIN txo USING (tx_id, vout)) AS deletes, (SELECT count(*) FROM d ANTI JOIN txo USING (tx_id, vout)) AS failed_deletes, (SELECT count(*) FROM d) AS deferred_deletes, (SELECT count(*) FROM d) AS longest_queue_deletes, (SELECT count(*) FROM txo ANTI JOIN d USING (tx_id, vout)) AS n_left")
def store_erase(spark, sf_dir):
    """What a store counts of deletes that wait, are done and fail, and how many entries are left."""
    store = _filled(spark, sf_dir)
    store.erase(_wanted(spark, sf_dir))
    store.drain()
    names = ["inserts", "deletes", "failed_deletes", "deferred_deletes", "longest_queue_deletes"]
    return store.entries().agg(F.count("*").alias("n_left")).select(*(F.lit(store.counters[c]).cast("long").alias(c) for c in names), "n_left")


@register("store_copy", f"{_LAID} SELECT container, count(*) AS n, CAST(sum(locking_script_size) AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS n_batches, min(creation_block) AS min_height, max(creation_block) AS max_height FROM laid GROUP BY 1")
def store_copy(spark, sf_dir):
    """Statistics of a store that another was migrated to."""
    other = Store(spark, shared_folder(spark, "store"))
    _filled(spark, sf_dir).copy_to(other)
    return other.statistics()


@register("lookups_by_partitions", f"{_WANTED}, d AS (SELECT DISTINCT tx_id, vout FROM w SEMI JOIN txo USING (tx_id, vout)) SELECT CAST(unnest([1, 4]) AS INT) AS partitions, (SELECT count(*) FROM d) AS found, CAST(0 AS BIGINT) AS unexpected")
def lookups_by_partitions(spark, sf_dir):
    """Lookups timed at two degrees of parallelism; of the result only what time has no part in."""
    store = _filled(spark, sf_dir)
    wanted = _wanted(spark, sf_dir).distinct()
    return ingest.timed_lookups(store, wanted.withColumn("should_exist", F.col("vout") < 1000), [1, 4], repeats=1).select("partitions", "found", "unexpected")


@register("history_files", "SELECT creation_block, coalesce(CAST(spent_block AS VARCHAR), 'Unspent') AS spent_block, value, locking_script_size, coalesce(CAST(unlocking_script_size AS VARCHAR), '-') AS unlocking_script_size, CAST(tx_coinbase AS VARCHAR) AS tx_coinbase, CAST(op_return AS VARCHAR) AS op_return FROM txo")
def history_files(spark, sf_dir):
    """A history written as CSV files of bounded length, and read back by position."""
    path = shared_folder(spark, "history")
    files.write_history(txo(spark, sf_dir), path, 10_000)
    return files.read_history(spark, path)


_EPOCH = "CAST(CASE WHEN creation_block < 100000 THEN 0 WHEN creation_block < 300000 THEN 1 WHEN creation_block < 500000 THEN 2 WHEN creation_block < 600000 THEN 3 WHEN creation_block < 700000 THEN 4 ELSE 5 END AS INT)"


@register("history_parquet", f"SELECT {_EPOCH} AS epoch, event, count(*) AS n, CAST(sum(value) AS BIGINT) AS sum_value, CAST(sum(duration) AS BIGINT) AS sum_duration FROM txo GROUP BY 1, 2")
def history_parquet(spark, sf_dir):
    """CSV files normalised into Parquet by epoch, and summed from there."""
    path = shared_folder(spark, "history")
    files.write_history(txo(spark, sf_dir), f"{path}/csv")
    files.csv_to_parquet(spark, f"{path}/csv", f"{path}/parquet")
    return spark.read.parquet(f"{path}/parquet").groupBy("epoch", "event").agg(F.count("*").alias("n"), F.sum("value").alias("sum_value"), F.sum(F.col("duration").cast("long")).alias("sum_duration"))


@register("history_columns", "SELECT value, count(*) AS n FROM txo GROUP BY 1")
def history_columns(spark, sf_dir):
    """A projected scan of history files."""
    path = shared_folder(spark, "history")
    files.write_history(txo(spark, sf_dir), path)
    return files.read_history(spark, path, ["value"]).groupBy("value").agg(F.count("*").alias("n"))


@register("survival_sink", f"{_KM} SELECT duration, at_risk, deaths, round(survival, 9) AS survival FROM km")
def survival_sink(spark, sf_dir):
    """The survival curve written and read back."""
    path = shared_folder(spark, "survival")
    survival.save_curve(survival.kaplan_meier(txo(spark, sf_dir)), path)
    return survival.load_curve(spark, path).withColumn("survival", F.round("survival", 9))


FIRST, TAKEN = 9_990, 40


@register("raw_blocks", f"SELECT CAST(range AS INT) AS height, printf('%08X', range * 7919) AS raw FROM range({FIRST}, {FIRST + TAKEN})", "")
def raw_blocks(spark, sf_dir):
    """Hex lines in two files of 10,000 blocks each; blocks are skipped and taken by height."""
    path = shared_folder(spark, "blocks")
    for start in (0, files.FILE_STEP):
        heights = spark.range(start, start + files.FILE_STEP, numPartitions=1)
        heights.select(F.lpad(F.hex(F.col("id") * 7919), 8, "0").alias("value")).write.text(f"{path}/block-raw-{start}-{start + files.FILE_STEP - 1}.csv")
    # a folder stands for each file here, so the number in its name is that of the folder
    found = None
    for start in (0, files.FILE_STEP):
        lines = files.read_lines(spark, f"{path}/block-raw-{start}-{start + files.FILE_STEP - 1}.csv").withColumn("file", F.lit(f"block-raw-{start}-{start + files.FILE_STEP - 1}.csv"))
        found = lines if found is None else found.unionAll(lines)
    return files.blocks_of(found, FIRST, TAKEN).select("height", F.hex("raw").alias("raw"))


@register("hex_round_trip", "SELECT DISTINCT lpad(printf('%X', tx_id), 8, '0') || lpad(printf('%X', vout), 2, '0') || '000000' AS key FROM txo")
def hex_round_trip(spark, sf_dir):
    """Hex texts decoded to hashes and packed with the index into keys; shown as hex again."""
    raw = files.hex_bytes(F.lpad(F.hex("tx_id"), 8, "0"))
    return txo(spark, sf_dir).select(F.hex(scalars.outpoint_bytes(raw, F.col("vout"))).alias("key")).distinct()


@register("op_return_scripts", "SELECT op_return, count(*) AS n FROM txo GROUP BY 1 UNION ALL SELECT false, 2")
def op_return_scripts(spark, sf_dir):
    """Outputs told by the first byte of their script; an empty and a null script are none."""
    script = F.unhex(F.when(F.col("op_return"), F.lit("6A04")).otherwise(F.lit("766A")))
    odd = spark.sql("SELECT CAST(X'' AS BINARY) AS script UNION ALL SELECT CAST(NULL AS BINARY)")
    found = txo(spark, sf_dir).select(script.alias("script")).groupBy(scalars.is_op_return(F.col("script")).alias("op_return")).agg(F.count("*").alias("n"))
    return found.unionAll(odd.groupBy(scalars.is_op_return(F.col("script")).alias("op_return")).agg(F.count("*").alias("n")))


_FILED = ", named AS (SELECT 'data/part-3/utxo-history-' || (tx_id % 17) || '.csv' AS file, event FROM txo)"


def _file(spark, sf_dir):
    return F.concat(F.lit("data/part-3/utxo-history-"), (F.col("tx_id") % 17).cast("string"), F.lit(".csv"))


@register("file_order", f"{_FILED}, f AS (SELECT file, CAST(regexp_extract(file, '([0-9]+)[^0-9]*$', 1) AS INT) AS number, count(*) AS n FROM named GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY number) AS INT) AS place FROM f")
def file_order(spark, sf_dir):
    """Files in the order of the last number in their names."""
    from pyspark.sql.window import Window

    named = txo(spark, sf_dir).select(_file(spark, sf_dir).alias("file")).groupBy("file").agg(F.count("*").alias("n")).withColumn("number", files.file_number(F.col("file")))
    return named.withColumn("place", F.row_number().over(Window.orderBy("number")))


@register("first_unspent_file", ", l AS (SELECT tx_id, CAST(tx_id % 17 AS INT) AS number, tx_id % 3 = 1 AND NOT event AND tx_id % 17 > 4 AS has FROM txo) SELECT min(number) AS file_number FROM l WHERE has")
def first_unspent_file(spark, sf_dir):
    """The smallest file number whose lines hold an unspent output."""
    lines = txo(spark, sf_dir).where("tx_id % 3 = 1").select(_file(spark, sf_dir).alias("file"), F.concat_ws(",", F.col("creation_block"), F.when(F.col("event") | (F.col("tx_id") % 17 <= 4), "1").otherwise("Unspent"), F.lit("x")).alias("text"))
    return files.first_file_with(lines)


@register("benchmark_log", f"{_TOTALS} SELECT CAST(batch AS INT) AS batch, CAST(n_tx AS DOUBLE) AS txs, CAST(n_inputs AS DOUBLE) AS inputs, CAST(n_outputs AS DOUBLE) AS outputs, n_outputs AS inserts, n_inputs AS deletes FROM totals")
def benchmark_log(spark, sf_dir):
    """A benchmark's log written as CSV and read back."""
    from strataledger.operators import access

    path = shared_folder(spark, "log")
    rows = access.batch_totals(txo(spark, sf_dir), BATCH).select(
        "batch", F.col("n_tx").alias("txs"), F.col("n_inputs").alias("inputs"), F.col("n_outputs").alias("outputs"), F.lit(1.5).alias("time"), F.lit(2.5).alias("tps"), F.col("n_outputs").alias("inserts"), F.col("n_inputs").alias("deletes")
    )
    rows.write.option("header", True).csv(path)
    return files.read_benchmark(spark, path).drop("time", "tps")


@register("entries_snapshot", f"SELECT count(*) AS n, count(*) FILTER (WHERE creation_block < {BATCH}) AS n_early FROM txo")
def entries_snapshot(spark, sf_dir):
    """A store scanned, counted and filtered."""
    store = _filled(spark, sf_dir)
    return store.entries().agg(F.count("*").alias("n")).crossJoin(store.entries_where(F.col("height") < BATCH).agg(F.count("*").alias("n_early")))


@register("store_files", "SELECT count(*) AS n, min(tx_id) AS min_key, max(tx_id) AS max_key, true AS bounded FROM txo")
def store_files(spark, sf_dir):
    """The files of a store that goes on to a new one after 100,000 rows: what they hold together, and that none holds more."""
    return _filled(spark, sf_dir).files().agg(F.sum("n").alias("n"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), (F.max("n") <= 100_000).alias("bounded"))
