"""Ledger state: spends resolved, batches netted and applied, keys looked up, entries laid out and compacted.

State is a function of rows: the entries after a batch are those before without the deleted keys, and the inserted
ones. Deferred operations of a mutable store are joins here; what could not be deleted or found is a result, not a queue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataledger.functions.scalars import bucket_count
from strataledger.operators.asof import covering
from strataledger.schema import KEY

#: Bytes of an entry beside its payload: key, height and length.
ENTRY_BYTES = 44


def resolve_spends(outputs: DataFrame, inputs: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """outputs with spent_height: null for unspent ones. One shuffled join emits both; an output is spent at most once."""
    spends = inputs.groupBy(*keys).agg(F.min("height").alias("spent_height"))
    return outputs.join(spends, list(keys), "left")


def unspent(outputs: DataFrame, inputs: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return outputs.join(inputs.select(*keys), list(keys), "left_anti")


def net(inserts: DataFrame, deletes: DataFrame, keys: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """A batch without the outputs that it creates and spends itself; order within the batch plays no part."""
    return inserts.join(deletes.select(*keys), list(keys), "left_anti"), deletes.join(inserts.select(*keys), list(keys), "left_anti")


def netting_counts(batches: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """batches (batch, op, key columns): per batch the inserts and deletes that are left, and the outputs netted away."""
    sides = batches.groupBy("batch", *keys).agg(F.count_if(F.col("op") == "insert").alias("i"), F.count_if(F.col("op") == "delete").alias("d"))
    return sides.groupBy("batch").agg(
        F.count_if((F.col("i") > 0) & (F.col("d") == 0)).alias("n_inserts"), F.count_if((F.col("i") == 0) & (F.col("d") > 0)).alias("n_deletes"), F.count_if((F.col("i") > 0) & (F.col("d") > 0)).alias("n_in_batch"),
    )


def apply_batch(state: DataFrame, inserts: DataFrame, deletes: DataFrame, keys: Sequence[str] = KEY, on_conflict: str = "first") -> tuple[DataFrame, DataFrame]:
    """(state after, keys that could not be deleted): netted, then deletes, then inserts.

    An inserted key that the state holds already is left alone with 'first' and replaced with 'last'.
    """
    if on_conflict not in ("first", "last"):
        raise ValueError("on_conflict is first or last")
    added, removed = net(inserts, deletes, keys)
    rest = state.join(removed.select(*keys), list(keys), "left_anti")
    failed = removed.join(state.select(*keys), list(keys), "left_anti")
    if on_conflict == "first":
        added = added.join(rest.select(*keys), list(keys), "left_anti")
    else:
        rest = rest.join(added.select(*keys), list(keys), "left_anti")
    return rest.unionByName(added), failed


def folded(operations: DataFrame, payload: Sequence[str], keys: Sequence[str] = KEY, on_conflict: str = "first") -> DataFrame:
    """(keys, held struct<batch, payload>, n_failed, n_operations): what any number of batches, applied in order, leave of each key.

    operations: batch, op ('insert' or 'delete'), key columns, payload columns. It is apply_batch for all batches at
    once: one aggregation by key, whose plan does not grow with the batches. A key that a batch both inserts and
    deletes is netted within it, else its deletes come before its inserts. held is null for keys that are gone;
    n_failed counts the deletes of keys that were not there, n_operations what netting has left. A key's operations meet in one row, so a key should not
    have more than thousands of batches. Batches may come in any order; rows with a null batch count for nothing.
    """
    if on_conflict not in ("first", "last"):
        raise ValueError("on_conflict is first or last")
    row = F.struct("batch", (F.col("op") == "insert").alias("i"), F.struct("batch", *payload).alias("e"))
    listed = operations.where("batch IS NOT NULL").groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("ops"))
    same = lambda x, side: F.exists("ops", lambda y: (y["batch"] == x["batch"]) & (y["i"] if side else ~y["i"]))
    left = F.when(F.size("ops") > 1, F.filter("ops", lambda x: F.when(x["i"], ~same(x, False)).otherwise(~same(x, True)))).otherwise(F.col("ops"))
    entry = operations.select(F.struct("batch", *payload).alias("e")).schema["e"].dataType
    start = F.struct(F.lit(None).cast(entry).alias("held"), F.lit(-1).cast(operations.schema["batch"].dataType).alias("at"), F.lit(0).alias("failed"))

    def step(s: Column, x: Column) -> Column:
        kept = s["held"].isNotNull() if on_conflict == "first" else F.lit(False)
        again = (s["at"] == x["batch"]) & ~x["i"]  # a delete asked for twice in a batch is one
        return F.struct(
            F.when(x["i"] & ~kept, x["e"]).when(x["i"], s["held"]).alias("held"), x["batch"].alias("at"), (s["failed"] + F.when(~x["i"] & s["held"].isNull() & ~again, 1).otherwise(0)).alias("failed")
        )

    end = F.aggregate("left", start, step)
    return listed.withColumn("left", left).withColumn("end", end).select(*keys, F.col("end.held").alias("held"), F.col("end.failed").alias("n_failed"), F.size("left").alias("n_operations"))


def operations_of(txo: DataFrame, blocks: int, payload: Sequence[str] = ("creation_block", "value")) -> DataFrame:
    """The inserts and deletes of a history (batch, op, key columns, payload), by batches of blocks; the history is read once."""
    at = lambda height: F.floor(F.col(height) / blocks).cast("int").alias("batch")
    both = F.array(F.struct(at("creation_block"), F.lit("insert").alias("op")), F.struct(at("spent_block"), F.lit("delete").alias("op")))
    rows = txo.select(*KEY, *payload, F.explode(both).alias("o")).where("o.batch IS NOT NULL")
    shown = [F.when(F.col("o.op") == "insert", F.col(c)).alias(c) for c in payload]
    return rows.select("o.batch", "o.op", *KEY, *shown)


def fold_batches(txo: DataFrame, blocks: int) -> DataFrame:
    """The ledger (key columns, creation_block, value) after every batch of blocks; deletes of unknown keys are an error.

    Batches go up to the greatest height of a creation or spend; an empty history leaves an empty ledger.
    """
    ends = folded(operations_of(txo, blocks), ["creation_block", "value"])
    sound = F.when(F.col("n_failed") > 0, F.raise_error(F.concat_ws(" ", F.lit("delete of an unknown key:"), *KEY)).cast("boolean")).otherwise(F.col("held").isNotNull())
    return ends.where(sound).select(*KEY, "held.creation_block", "held.value")


def state_at(txo: DataFrame, height: int) -> DataFrame:
    """Outputs that exist after the block of that height."""
    return txo.where((F.col("creation_block") <= height) & (F.col("spent_block").isNull() | (F.col("spent_block") > height)))


def lookup(ledger: DataFrame, wanted: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """wanted with the ledger's columns and found; Spark broadcasts wanted where it is small and shuffles otherwise."""
    there = ledger.withColumn("found_", F.lit(True))
    return wanted.join(there, list(keys), "left").withColumn("found", F.coalesce("found_", F.lit(False))).drop("found_")


def missing_keys(ledger: DataFrame, wanted: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return wanted.select(*keys).join(ledger.select(*keys), list(keys), "left_anti")


def deduplicate(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = KEY, keep: str = "first") -> DataFrame:
    """One row a key, the first or last by order, which should be total. A partial extremum a task, no window over a hot key."""
    packed = F.struct(*order, *[c for c in rows.columns if c not in order])
    best = F.min(packed) if keep == "first" else F.max(packed)
    return rows.groupBy(*[F.col(k).alias(f"key_{k}") for k in keys]).agg(best.alias("best")).select(*[F.col(f"best.{c}").alias(c) for c in rows.columns])


def lookup_workload(txo: DataFrame, low: int, high: int, misses: int = 0, keys: Sequence[str] = KEY) -> DataFrame:
    """Keys spent in [low, high) that existed before, with should_exist; every misses-th key also made up as a known miss."""
    hits = txo.where((F.col("spent_block") >= low) & (F.col("spent_block") < high) & (F.col("creation_block") < low)).select(*keys, F.lit(True).alias("should_exist"))
    if not misses:
        return hits
    absent = hits.where(F.pmod(F.col(keys[0]), F.lit(misses)) == 0).select((-F.col(keys[0]) - 1).alias(keys[0]), *keys[1:], F.lit(False).alias("should_exist"))
    return hits.unionByName(absent)


def with_layout(ledger: DataFrame, container: Column, version: Column) -> DataFrame:
    """Entries with their size class and version of file group."""
    return ledger.withColumns({"container": container, "version": version})


def zone_map(ledger: DataFrame, key: str = "tx_id", height: str = "creation_block") -> DataFrame:
    """Per container and version: least and greatest key and height, and entries."""
    return ledger.groupBy("container", "version").agg(
        F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.min(height).alias("min_height"), F.max(height).alias("max_height"), F.count("*").alias("n")
    )


def zone_candidates(wanted: DataFrame, zones: DataFrame, key: str = "tx_id") -> DataFrame:
    """wanted with the number of file groups whose key range holds each key, by a sweep over the ends of the ranges."""
    return covering(wanted, zones, key, "min_key", "max_key", "n_zones")


#: Keys of a cell: a task ranks the rows of one cell of a group at a time.
CELL = 100_000


def placed(rows: DataFrame, group: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """rows with place: the rank from 0 by key within the group.

    Rows are counted by cells of the first key (a whole number); a place is the rank in the cell plus the rows of the
    cells before, so a large group is ranked by many tasks and only its cells are put in order.
    """
    cell = F.floor(F.col(keys[0]) / CELL)
    counts = rows.groupBy(*group, cell.alias("cell")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(c).alias(f"of_{c}") for c in group), F.col("cell").alias("of_cell"), before.alias("start"))
    ranked = rows.withColumn("cell", cell).withColumn("rank", F.row_number().over(Window.partitionBy(*group, "cell").orderBy(*keys)) - 1)
    same = F.col("cell") == F.col("of_cell")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return ranked.join(starts, same).withColumn("place", F.col("start") + F.col("rank")).drop("cell", "rank", "start", "of_cell", *(f"of_{c}" for c in group))


def compact(ledger: DataFrame, target_rows: int) -> DataFrame:
    """Entries with versions numbered anew by container, so that each but the last holds target_rows; rows are unchanged.

    The place of an entry is the entries of smaller versions, known from counts, and its place among its own version's.
    """
    sizes = ledger.groupBy("container", "version").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("container").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("container").alias("c"), F.col("version").alias("v"), before.alias("offset"))  # a row a file group
    found = placed(ledger, ["container", "version"]).join(offsets, (F.col("container") == F.col("c")) & (F.col("version") == F.col("v")))
    return found.withColumn("version", F.floor((F.col("offset") + F.col("place")) / target_rows).cast("int")).drop("place", "offset", "c", "v")


def layout_report(ledger: DataFrame, capacity: int, size: str = "locking_script_size") -> DataFrame:
    """Per container: versions, entries, stored bytes, fill ratio of all versions' capacity, and slots wasted."""
    return ledger.groupBy("container").agg(F.countDistinct("version").alias("n_versions"), F.count("*").alias("n"), F.sum(F.col(size).cast("long")).alias("bytes")).withColumns(
        {"fill": F.col("n") / (F.col("n_versions") * capacity), "wasted": F.col("n_versions") * capacity - F.col("n")}
    )


def deferred(ledger: DataFrame, erased: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """erased (keys, height, version) with depth: how many versions of files lie between the newest at that height and the entry's; null where there is no entry.

    A delete of depth 0 is done at once, others wait for the files of older versions.
    """
    entries = ledger.select(*keys, F.col("version").alias("entry_version"))
    return erased.join(entries, list(keys), "left").withColumn("depth", F.when(F.col("entry_version").isNotNull(), F.greatest(F.col("version") - F.col("entry_version"), F.lit(0)))).drop("entry_version")


def container_operations(erased: DataFrame) -> DataFrame:
    """Per container of erased (container, depth): deletes asked for, done at once, deferred and failed; files are never rehashed."""
    return erased.groupBy("container").agg(
        F.count("*").alias("n_asked"), F.count_if(F.col("depth") == 0).alias("n_deleted"), F.count_if(F.col("depth") > 0).alias("n_deferred"), F.count_if(F.col("depth").isNull()).alias("n_failed"), F.lit(None).cast("int").alias("n_rehash")
    )


def deferred_summary(erased: DataFrame) -> DataFrame:
    """Of erased (batch, depth): deferred and failed deletes, runs that process them (a batch each), the longest queue, and depths."""
    waits = F.col("depth") > 0
    runs = erased.groupBy("batch").agg(
        F.count_if(waits).alias("waiting"), F.count_if(F.col("depth").isNull()).alias("failed"), F.sum(F.when(waits, F.col("depth"))).alias("depths"), F.max(F.when(waits, F.col("depth"))).alias("deepest")
    )
    return runs.agg(
        F.sum("waiting").alias("n_deferred"), F.sum("failed").alias("n_failed"), F.count_if(F.col("waiting") > 0).alias("n_runs"), F.max("waiting").alias("longest_queue"),
        (F.sum("depths") / F.sum("waiting")).alias("mean_depth"), F.max("deepest").alias("max_depth"),
    )


def memory_estimate(ledger: DataFrame, limits: Sequence[int], size: str = "locking_script_size") -> DataFrame:
    """Per container: what its files take (slots of the class's size for the buckets that each version needs), what its entries need, the ratio and what is wasted."""
    slot = F.element_at(F.array(*(F.lit(n + ENTRY_BYTES) for n in limits)), F.col("container") + 1).cast("long")
    files = ledger.groupBy("container", "version").agg(F.count("*").alias("n"), F.sum(F.col(size) + F.lit(ENTRY_BYTES)).alias("used"))
    sized = files.withColumn("estimate", bucket_count(F.col("n")) * slot)
    return sized.groupBy("container").agg(F.count("*").alias("n_versions"), F.sum("estimate").alias("estimate"), F.sum("used").alias("used")).withColumns({"fill": F.col("used") / F.col("estimate"), "wasted": F.col("estimate") - F.col("used")})


def rotated(rows: DataFrame, limit: int, height: str = "creation_block", keys: Sequence[str] = KEY) -> DataFrame:
    """rows with version: a set that goes on to a new version after every limit inserts, in order of height and key.

    Inserts are counted by height first, so one row a height is in one order, and rows are placed within theirs.
    """
    sizes = rows.groupBy(F.col(height).alias("at_")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = placed(rows, [height], keys).join(sizes.select("at_", before.alias("before_")), F.col(height) == F.col("at_"))
    return found.withColumn("version", F.floor((F.col("before_") + F.col("place")) / limit).cast("int")).drop("place", "at_", "before_")


def cached_order(files: DataFrame) -> DataFrame:
    """files (container, version) with place: containers in order, the newest version of each first."""
    by = [F.asc("container"), F.desc("version")]
    return files.withColumn("place", F.row_number().over(Window.orderBy(*by)))  # a row a file group
