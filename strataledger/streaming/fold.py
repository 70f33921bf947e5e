"""A ledger folded over a stream of operations.

Every operation carries the batch of the ledger that it belongs to, and operations count in the order of those
batches, whatever micro-batch brings them: files may arrive late or out of order. State is versioned: a micro-batch
appends its operations under its own number, so it costs what it holds and not what the ledger holds; ``compact``
rewrites a ledger now and then. A micro-batch that is run again overwrites its own folder, so a restart after a lost
driver or executor changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataledger.operators import state
from strataledger.schema import KEY
from strataledger.session import shared_folder

OPERATIONS = "batch int, op string, tx_id long, vout int, creation_block int, value long"


def write_batch(rows: DataFrame, number: int, path: str) -> None:
    """One micro-batch, with the ledger's batch of each operation.

    What one ledger batch creates and spends itself is never written if the micro-batch holds both; other pairs are
    netted when the ledger is read.
    """
    sides = rows.groupBy("batch", *KEY).agg(
        F.count_if(F.col("op") == "insert").alias("i"), F.count_if(F.col("op") == "delete").alias("d"), F.first("creation_block", ignorenulls=True).alias("creation_block"), F.first("value", ignorenulls=True).alias("value")
    )
    left = sides.where("(i > 0) <> (d > 0)").select("batch", F.when(F.col("i") > 0, "insert").otherwise("delete").alias("op"), *KEY, "creation_block", "value")
    left.write.mode("overwrite").parquet(f"{path}/part={number}")


def _ends(spark: SparkSession, path: str) -> DataFrame:
    return state.folded(spark.read.schema(OPERATIONS).parquet(path).select("batch", "op", *KEY, "creation_block", "value"), ["creation_block", "value"])


def ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, failed deletes): what the batches leave, and the keys of deletes that found nothing."""
    ends = _ends(spark, path)
    return ends.where("held IS NOT NULL").select(*KEY, "held.creation_block", "held.value"), ends.where("n_failed > 0").select(*KEY)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The ledger rewritten as one part in a new folder, without deletes; entries keep the batch that inserted them."""
    entries = _ends(spark, path).where("held IS NOT NULL").select("held.batch", F.lit("insert").alias("op"), *KEY, "held.creation_block", "held.value")
    entries.write.mode("overwrite").parquet(f"{to}/part=0")


def start(operations: DataFrame, path: str, checkpoint: str):
    """The running query that folds a stream of OPERATIONS into the ledger at path."""
    return operations.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, txo: DataFrame, blocks: int = 100_000, files: int = 4) -> DataFrame:
    """The ledger after streaming a history, some files a micro-batch, in whatever order the files are listed."""
    base = shared_folder(spark, "stream")
    state.operations_of(txo, blocks).hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{base}/in")
    stream = spark.readStream.schema(OPERATIONS).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    start(stream, f"{base}/ledger", f"{base}/progress").awaitTermination()
    return ledger(spark, f"{base}/ledger")[0]
