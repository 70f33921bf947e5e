"""Statistics of an access log, of batches, and of two benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataledger.functions.scalars import saturating_age


def access_summary(log: DataFrame) -> DataFrame:
    """Operations, hits by place, mean depth, and mean age of what was found. log: access_height, insertion_height, depth, is_cache_hit, found, op."""
    age = saturating_age(F.col("access_height"), F.col("insertion_height"))
    hit = F.col("found")
    return log.agg(
        F.count("*").alias("n_ops"), F.count_if(hit).alias("n_found"), F.count_if(hit & (F.col("depth") == 0)).alias("n_current"), F.count_if(hit & F.col("is_cache_hit")).alias("n_cached"),
        F.avg("depth").alias("mean_depth"), F.avg(F.when(hit, age)).alias("mean_age"), F.try_divide(F.count_if(hit).cast("double"), F.count("*").cast("double")).alias("hit_rate"),
    )


def access_range(log: DataFrame, low: int, high: int) -> DataFrame:
    """The same for accesses in [low, high]: finds and erases, greatest depth, and least and greatest age above 0."""
    age = saturating_age(F.col("access_height"), F.col("insertion_height"))
    aged = F.when(F.col("found") & (age > 0), age)
    return log.where(F.col("access_height").between(low, high)).agg(
        F.count_if(F.col("op") == "find").alias("n_find"), F.count_if(F.col("op") == "erase").alias("n_erase"), F.count_if("found").alias("n_found"), F.max("depth").alias("max_depth"), F.min(aged).alias("min_age"), F.max(aged).alias("max_age")
    )


def not_found_by_depth(log: DataFrame) -> DataFrame:
    return log.where("NOT found").groupBy("depth").agg(F.count("*").alias("n"))


def batch_totals(txo: DataFrame, size: int) -> DataFrame:
    """Per batch of size blocks by creation: transactions, outputs, coinbase outputs, and outputs spent so far as inputs."""
    created = txo.groupBy(F.floor(F.col("creation_block") / size).cast("int").alias("batch")).agg(F.countDistinct("tx_id").alias("n_tx"), F.count("*").alias("n_outputs"))
    spent = txo.where("event").groupBy(F.floor(F.col("spent_block") / size).cast("int").alias("batch")).agg(F.count("*").alias("n_inputs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return created.join(spent, "batch", "full_outer").select("batch", zero("n_tx"), zero("n_outputs"), zero("n_inputs"))


def cumulative(batches: DataFrame, columns: list[str], order: str = "batch") -> DataFrame:
    """batches with running totals; a row a batch, so one ordered task is enough."""
    so_far = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return batches.withColumns({f"total_{c}": F.sum(c).over(so_far) for c in columns})


def smoothed(batches: DataFrame, x: Column, start: float, weight: float = 0.1, order: str = "batch") -> DataFrame:
    """(batch, factor): f = weight * x + (1 - weight) * f, from start, in order; null x leaves f as it was.

    Order matters, so the list of batches is folded as one array.
    """
    listed = batches.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), x.cast("double").alias("x")))).alias("all"))
    first = F.struct(F.lit(float(start)).alias("f"), F.array().cast("array<struct<o:int,f:double>>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        f = F.coalesce(b["x"] * weight + s["f"] * (1 - weight), s["f"])
        return F.struct(f.alias("f"), F.concat(s["out"], F.array(F.struct(b["o"].cast("int").alias("o"), f.alias("f")))).alias("out"))

    return listed.select(F.explode(F.aggregate("all", first, step)["out"]).alias("x")).select(F.col("x.o").alias(order), F.col("x.f").alias("factor"))


def compare_benchmarks(one: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(speed-up by common batch, its greatest, least, mean and median with those of both rates)."""
    both = one.select("batch", F.col("tps").alias("tps_one")).join(other.select("batch", F.col("tps").alias("tps_other")), "batch").withColumn("speedup", F.try_divide("tps_one", "tps_other"))
    of = lambda c: [F.max(c).alias(f"max_{c}"), F.min(c).alias(f"min_{c}"), F.avg(c).alias(f"mean_{c}"), F.percentile(c, 0.5).alias(f"median_{c}")]
    return both, both.agg(*of("tps_one"), *of("tps_other"), *of("speedup"))


def operation_rates(log: DataFrame) -> DataFrame:
    """Per operation of an access log: how many, found and not, the share found, and how many for each height that the log spans."""
    hit = F.col("found")
    span = F.max("access_height") - F.min("access_height") + 1
    return log.groupBy("op").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("n_found"), F.count_if(~hit).alias("n_failed"), (F.count_if(hit) / F.count("*")).alias("hit_rate"), (F.count("*") / span).alias("per_height")
    )


#: What a batch is first expected to hold of inserts, deletes and OP_RETURN outputs for each transaction.
INSERT_FACTOR, DELETE_FACTOR, OP_RETURN_FACTOR = 6.0, 3.0, 0.2


def sizing_factors(batches: DataFrame) -> DataFrame:
    """(batch, insert_factor, delete_factor, op_return_factor) smoothed over batches (batch, n_tx, n_inserts, n_deletes, n_op_returns).

    A batch without deletes leaves the factor of deletes as it was; batches without transactions are left out.
    """
    rows = batches.where("n_tx > 0")
    per_tx = lambda c: F.col(c) / F.col("n_tx")
    parts = [("insert_factor", per_tx("n_inserts"), INSERT_FACTOR), ("delete_factor", F.when(F.col("n_deletes") > 0, per_tx("n_deletes")), DELETE_FACTOR), ("op_return_factor", per_tx("n_op_returns"), OP_RETURN_FACTOR)]
    out = None
    for name, x, start in parts:
        part = smoothed(rows, x, start).withColumnRenamed("factor", name)
        out = part if out is None else out.join(part, "batch")
    return out
