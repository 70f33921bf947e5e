"""A ledger kept in a folder: batches of inserts and deletes, lookups, scans, rotation, compaction and statistics.

Each batch is a Parquet folder of its own with tombstones, in files of bounded length ordered by key; entries are what
the last operation on a key left. Deletes wait until ``drain`` unless told otherwise, as do lookups, and both come back
as what was done and what failed. Lookups are held against the rows of the wanted keys only: files are skipped by
their ranges of keys, and nothing is grouped before that.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataledger.functions.scalars import size_class
from strataledger.operators import state
from strataledger.schema import KEY

ENTRY = "tx_id long, vout int, height int, value long, size int"
_KEYS = "tx_id long, vout int"
_ROW = f"{ENTRY}, deleted boolean, batch int"


class Store:
    """Entries (tx_id, vout, height, value, size) under a path that driver and executors share.

    A batch goes on to a new file after rows_per_file rows. counters tells what this object has done so far: rows
    inserted, deletes and lookups done and failed, those that waited, and the longest queue of each.
    """

    def __init__(self, spark: SparkSession, path: str, remove_existing: bool = False, rows_per_file: int = 1_000_000):
        self.spark, self.path, self.rows_per_file = spark, path.rstrip("/"), rows_per_file
        self.counters: Counter[str] = Counter()
        self._deletes: list[DataFrame] = []
        self._lookups: list[DataFrame] = []
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if remove_existing:
            self._remove(self.path)
        self._next = 1 + max(self.batches(), default=-1)

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _remove(self, path: str) -> None:
        if self._fs.exists(self._at(path)):
            self._fs.delete(self._at(path), True)

    def batches(self) -> list[int]:
        """Numbers of the batches written, in order."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def files(self) -> DataFrame:
        """(file, batch, n, min_key, max_key): the ranges by which lookups skip files."""
        return self._rows().groupBy(F.col("_metadata.file_path").alias("file"), "batch").agg(F.count("*").alias("n"), F.min("tx_id").alias("min_key"), F.max("tx_id").alias("max_key"))

    def _rows(self) -> DataFrame:
        if not self.batches():
            return self.spark.createDataFrame([], _ROW)
        return self.spark.read.schema(_ROW).parquet(self.path)

    def _append(self, rows: DataFrame) -> DataFrame:
        """What was written as the next batch; its count comes from the files' footers."""
        path = f"{self.path}/batch={self._next}"
        rows.sortWithinPartitions(*KEY).write.option("maxRecordsPerFile", self.rows_per_file).mode("overwrite").parquet(path)
        self._next += 1
        return self.spark.read.schema(f"{ENTRY}, deleted boolean, was_there boolean").parquet(path)

    @staticmethod
    def _left(rows: DataFrame) -> DataFrame:
        first = F.struct("batch", "height", "value", "size")
        ends = rows.where("deleted").groupBy(*KEY).agg(F.max("batch").alias("gone"))
        live = rows.where("NOT deleted").join(ends, list(KEY), "left").where("gone IS NULL OR batch >= gone")
        return live.groupBy(*KEY).agg(F.min(first).alias("e")).select(*KEY, "e.height", "e.value", "e.size", "e.batch")

    def entries(self) -> DataFrame:
        """Entries with the batch that wrote them last; a key inserted while present keeps its first entry."""
        return self._left(self._rows())

    def entries_of(self, wanted: DataFrame) -> DataFrame:
        """The entries of the wanted keys. Rows outside the range of the keys are skipped by the files' statistics, and the others dropped before any are grouped."""
        low, high = wanted.agg(F.min("tx_id"), F.max("tx_id")).first()
        if low is None:
            return self.entries().limit(0)
        return self._left(self._rows().where(F.col("tx_id").between(low, high)).join(wanted.select(*KEY), list(KEY), "left_semi"))

    def entries_where(self, condition: Column) -> DataFrame:
        return self.entries().where(condition)

    def count(self) -> int:
        return self.entries().count()

    def insert(self, rows: DataFrame) -> int:
        """Add entries; a key that is present keeps what it has. The rows written, present keys included."""
        n = self._append(rows.select(*KEY, "height", "value", "size", F.lit(False).alias("deleted"))).count()
        self.counters["inserts"] += n
        return n

    def erase(self, keys: DataFrame) -> None:
        """Ask for deletes, carried out by drain."""
        self._deletes.append(keys.select(*KEY))

    def find(self, keys: DataFrame) -> None:
        """Ask for lookups, answered by drain_lookups."""
        self._lookups.append(keys.select(*KEY))

    def _queued(self, asked: list[DataFrame], what: str) -> DataFrame:
        """What was asked for, each key once, written beside the store: it is read for its range, its rows and its length."""
        path = f"{self.path}.queue/{what}"
        reduce(DataFrame.unionAll, asked).distinct().write.mode("overwrite").parquet(path)
        queue = self.spark.read.schema(_KEYS).parquet(path)
        n = queue.count()
        self.counters[f"deferred_{what}"] += n
        self.counters[f"longest_queue_{what}"] = max(self.counters[f"longest_queue_{what}"], n)
        return queue

    def drain(self) -> tuple[int, DataFrame]:
        """(deletes done, keys that were not there) of all that was asked for; a key asked for twice counts once."""
        if not self._deletes:
            return 0, self.spark.createDataFrame([], _KEYS)
        wanted, self._deletes = self._queued(self._deletes, "deletes"), []
        found = state.lookup(self.entries_of(wanted), wanted)
        written = self._append(found.select(*KEY, "height", "value", "size", F.lit(True).alias("deleted"), F.col("found").alias("was_there")))
        done, failed = written.agg(F.count_if("was_there"), F.count_if(~F.col("was_there"))).first()
        self.counters.update(deletes=done, failed_deletes=failed)
        return done, written.where("NOT was_there").select(*KEY)

    def drain_lookups(self) -> tuple[DataFrame, DataFrame]:
        """(entries found, keys not found) of all that was asked for."""
        if not self._lookups:
            return self.entries().limit(0), self.spark.createDataFrame([], _KEYS)
        wanted, self._lookups = self._queued(self._lookups, "lookups"), []
        found = state.lookup(self.entries_of(wanted), wanted)
        return found.where("found").drop("found"), found.where("NOT found").select(*KEY)

    def apply(self, inserts: DataFrame, deletes: DataFrame) -> tuple[int, int, DataFrame]:
        """One batch: netted, deletes first, then inserts; (rows inserted, deletes done, keys that were not there)."""
        added, removed = state.net(inserts, deletes)
        self.erase(removed)
        done, failed = self.drain()
        return self.insert(added), done, failed

    def compact(self) -> None:
        """All entries as one batch, written beside the old ones before those go; entries do not change."""
        old = self.batches()
        self._append(self.entries().repartitionByRange(*KEY).select(*KEY, "height", "value", "size", F.lit(False).alias("deleted")))
        for number in old:
            self._remove(f"{self.path}/batch={number}")

    def statistics(self) -> DataFrame:
        """Per size class: entries, bytes, batches that hold them, least and greatest height."""
        laid = self.entries().withColumn("container", size_class(F.col("size")))
        return laid.groupBy("container").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("bytes"), F.countDistinct("batch").alias("n_batches"), F.min("height").alias("min_height"), F.max("height").alias("max_height"))

    def copy_to(self, other: Store) -> int:
        """All entries inserted into another store; the rows copied, checked there."""
        n = self.count()
        other.insert(self.entries())
        if (there := other.count()) < n:
            raise OSError(f"{there} of {n} entries arrived")
        return n
