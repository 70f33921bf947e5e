"""What the operators of this subpackage share: the shared folder, lineage cuts, text rules, row packing.

Words are ``[^\\x20\\x09-\\x0D]+`` unless an operator says otherwise; ``bytes.split()`` has exactly that rule on UTF-8.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where Spark runs in one process."""
    context = spark.sparkContext
    if where := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        if not context.getCheckpointDir():
            context.setCheckpointDir(where)
        return where
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


#: Rows of an Arrow batch: texts may be long, and a batch is held several times over on its way.
ARROW_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session, wherever the driver has it from, and keep Arrow batches small.

    A session that sets spark.sql.execution.arrow.maxRecordsPerBatch itself keeps its setting.
    """
    context, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(ARROW_ROWS))
    if getattr(context, "_strataledger_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="package-")
    staged = Path(folder, "staged")
    shutil.copytree(package, staged / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, package.name), "zip", staged))
    context._strataledger_shipped = True


def cut(df: DataFrame, gather: bool = False) -> DataFrame:
    """The rows, written once to the shared folder: later steps neither recompute them nor depend on executors' disks.

    gather first brings what many tasks made of large rows (a scan of texts, say) into partitions of ordinary size, as
    short rows would otherwise go to as many small files.
    """
    shared_dir(df.sparkSession)
    return (df.hint("rebalance") if gather else df).checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else, so that every engine agrees."""
    return F.translate(text, UPPER, LOWER)


def normalised_line(line: Column) -> Column:
    """A line as it is compared: A-Z lower-cased, runs of white space one blank, none at the ends."""
    return ascii_lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a table of short rows may be broadcast: a few tens of megabytes.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A cut table of short rows, marked for broadcast if it has at most limit rows; beyond, the join shuffles it."""
    return F.broadcast(df) if df.count() <= limit else df


def looked_up(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A table of one short row a key, cut, to be joined to rows of which many may share a key.

    At most limit rows are broadcast. More are dealt out anew: a table that comes out of an aggregation is still
    partitioned by its key, and a join that makes use of that cannot be split where a key is hot.
    """
    df = cut(df)
    return F.broadcast(df) if df.count() <= limit else df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
