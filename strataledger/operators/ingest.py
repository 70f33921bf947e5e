"""A history replayed into a store, batch by batch, and timed lookups against it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataledger.log import logger
from strataledger.operators.store import Store
from strataledger.schema import KEY


@dataclass
class Batch:
    """What a batch held and took, and the totals so far."""

    batch: int
    inserts: int
    deletes: int
    seconds: float
    total_inserts: int = 0
    total_deletes: int = 0
    total_seconds: float = 0.0

    @property
    def rate(self) -> float:
        return (self.total_inserts + self.total_deletes) / self.total_seconds if self.total_seconds else 0.0


def run_batches(numbers: list[int], process: Callable[[int], tuple[int, int]], after: Callable[[Batch], None] | None = None) -> list[Batch]:
    """process(number) -> (inserts, deletes) for each batch in order; after sees every batch with running totals. Only process is timed."""
    out: list[Batch] = []
    for number in numbers:
        began = time.perf_counter()
        inserts, deletes = process(number)
        b = Batch(number, inserts, deletes, time.perf_counter() - began)
        last = out[-1] if out else Batch(-1, 0, 0, 0.0)
        b.total_inserts, b.total_deletes, b.total_seconds = last.total_inserts + inserts, last.total_deletes + deletes, last.total_seconds + b.seconds
        out.append(b)
        if after:
            after(b)
    return out


def replay(store: Store, txo: DataFrame, blocks: int = 100_000, compact_every: int = 20) -> list[Batch]:
    """A history (tx_id, vout, creation_block, spent_block, value, locking_script_size) folded into the store.

    Every batch is netted, deleted and inserted; a delete that fails ends the replay, as the history is then not sound.
    A batch is held against the rows of its own keys, and its counts are those of what it wrote.
    """
    log = logger()
    rows = txo.select(*KEY, F.col("creation_block").alias("height"), "value", F.col("locking_script_size").alias("size"), "spent_block")
    last = rows.agg(F.max(F.greatest("height", F.coalesce("spent_block", F.lit(0))))).first()[0] or 0

    def process(number: int) -> tuple[int, int]:
        low, high = number * blocks, (number + 1) * blocks
        made = rows.where((F.col("height") >= low) & (F.col("height") < high)).drop("spent_block")
        gone = rows.where((F.col("spent_block") >= low) & (F.col("spent_block") < high)).select(*KEY)
        added, done, failed = store.apply(made, gone)
        if (n := failed.count()) > 0:
            raise RuntimeError(f"batch {number}: {n} deletes of unknown keys")
        if (number + 1) % compact_every == 0:
            store.compact()
        return added, done

    return run_batches(list(range(last // blocks + 1)), process, lambda b: log.info("batch %d: %d in, %d out, %.0f a second", b.batch, b.inserts, b.deletes, b.rate))


def batches_table(store: Store, done: list[Batch]) -> DataFrame:
    """The batches as rows, for access.compare_benchmarks and others."""
    return store.spark.createDataFrame([(b.batch, b.inserts, b.deletes, b.seconds, b.rate / 1000) for b in done], "batch int, inserts long, deletes long, seconds double, tps double")


def timed_lookups(store: Store, workload: DataFrame, partitions: list[int], repeats: int = 3) -> DataFrame:
    """(partitions, best, mean, worst, found, unexpected): lookups of a workload (keys, should_exist) at several degrees of parallelism."""
    out = []
    for n in partitions:
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            store.find(workload.repartition(n, *KEY))
            found, missing = store.drain_lookups()
            hits = found.select(*KEY).join(workload, list(KEY)).agg(F.count("*"), F.count_if(~F.col("should_exist"))).first()
            lost = missing.join(workload, list(KEY)).agg(F.count_if("should_exist")).first()[0]
            took.append(time.perf_counter() - began)
        out.append((n, min(took), sum(took) / len(took), max(took), hits[0], hits[1] + lost))
    return store.spark.createDataFrame(out, "partitions int, best double, mean double, worst double, found long, unexpected long")


def as_dicts(done: list[Batch]) -> list[dict]:
    return [asdict(b) | {"rate": b.rate} for b in done]
