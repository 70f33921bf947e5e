"""Training rows, features, labels and their analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataledger.functions.scalars import block_epoch, right_closed, value_class
from strataledger.operators.stats import with_median
from strataledger.schema import HOT_BLOCKS, PATTERN_EDGES, VALUE_CLASSES

FEATURES = [
    "log_value", "total_script_size", "script_efficiency", "block_time_proxy", "creation_epoch", "is_coinbase", "block_density", "value_percentile_in_block", "is_likely_change", "is_likely_savings", "coinbase_maturity_factor",
    *(f"value_class_{name}" for name, _ in VALUE_CLASSES),
]


def clean(txo: DataFrame, horizon: int = HOT_BLOCKS) -> DataFrame:
    """Rows to learn from with target (spent within the horizon): positive, spendable, and either spent or old enough to tell."""
    kept = txo.where("value IS NOT NULL AND value > 0 AND NOT op_return")
    return kept.where(F.col("event") | (F.col("duration") >= horizon)).withColumn("target", (F.col("event") & (F.col("duration") <= horizon)).cast("int"))


def reliable(txo: DataFrame, horizon: int = HOT_BLOCKS) -> DataFrame:
    """Without zero durations and without unspent rows that are too young."""
    return txo.where((F.col("duration") > 0) & (F.col("event") | (F.col("duration") >= horizon)))


def hashed(*columns: str) -> Column:
    """A number of 0 to 999,999 by row, from whole columns with plain arithmetic: the same in every engine and run."""
    out = F.lit(17).cast("long")
    for c in columns:
        out = F.pmod(out * 31 + F.pmod(F.col(c).cast("long"), F.lit(1_000_003)) * 7919, F.lit(1_000_003))
    return F.pmod(out * 104_729, F.lit(1_000_000))


def sample(df: DataFrame, fraction: float, *columns: str) -> DataFrame:
    return df.where(hashed(*columns) < int(fraction * 1_000_000))


def capped_sample(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most `most` rows, those of the smallest hash: a bounded training set of any table."""
    return df.orderBy(hashed(*columns), *columns).limit(most)


def shuffled(df: DataFrame, *columns: str, seed: int = 42) -> DataFrame:
    """The rows in a seeded order of their hashed whole columns (all by default), whatever the partitioning; equal hashes in the columns' order."""
    columns = columns or tuple(df.columns)
    return df.orderBy(F.pmod(hashed(*columns) * (2 * seed + 1) + seed, F.lit(1_000_003)), *columns)


def split(df: DataFrame, label: str, test: float, *columns: str) -> DataFrame:
    """df with part 'train' or 'test'; every class is split by the same hash, so shares agree within chance."""
    return df.withColumn("part", F.when(hashed(*columns) < int(test * 1_000_000), "test").otherwise("train"))


def with_block_ranks(rows: DataFrame) -> DataFrame:
    """rows with block_density, the outputs of their block, and value_percentile_in_block, the average rank of the value among them.

    Outputs are first counted by block and value; windows go over these counts, and rows look both up. So a block
    with very many outputs costs a row for each different value, and on the outputs' side its rows can be split.
    """
    counts = rows.groupBy("creation_block", "value").agg(F.count("*").alias("n"))
    block = Window.partitionBy("creation_block")
    below = F.coalesce(F.sum("n").over(block.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    density = F.sum("n").over(block)
    placed = counts.select(
        F.col("creation_block").alias("block_"), F.col("value").alias("value_"), density.alias("block_density"), ((below + 1 + (F.col("n") - 1) / F.lit(2.0)) / density).alias("value_percentile_in_block")
    )
    return rows.join(placed, F.col("creation_block").eqNullSafe(F.col("block_")) & F.col("value").eqNullSafe(F.col("value_"))).drop("block_", "value_")


def features(rows: DataFrame, leak_free: bool = False) -> DataFrame:
    """rows with the 17 features. leak_free leaves the unlocking script, known at spending only, out of the sizes."""
    return of_ranked(with_block_ranks(rows), leak_free)


def of_ranked(rows: DataFrame, leak_free: bool = False) -> DataFrame:
    """The features of rows that have their block ranks: each row's own arithmetic."""
    locking = F.col("locking_script_size")
    size = locking if leak_free else locking + F.coalesce("unlocking_script_size", F.lit(0))
    log_value = F.log10(F.col("value") + F.lit(1.0))
    classes = value_class(F.col("value"))
    out = rows.withColumns(
        {
            "log_value": log_value, "total_script_size": size, "block_time_proxy": F.col("creation_block") % 144, "creation_epoch": block_epoch(F.col("creation_block")), "is_coinbase": F.col("tx_coinbase").cast("int"),
            "is_likely_change": (F.col("value") < 10_000) & (F.col("value") > 546), "is_likely_savings": F.col("value") > 100_000_000,
        }
    )
    return out.withColumns(
        {"script_efficiency": F.col("value") / (F.col("total_script_size") + 1), "coinbase_maturity_factor": F.col("is_coinbase") * log_value}
        | {f"value_class_{name}": F.coalesce(classes == name, F.lit(False)) for name, _ in VALUE_CLASSES}
    )


def correlations(rows: DataFrame, names: list[str], target: str = "target") -> DataFrame:
    """(feature, correlation) with the target in one pass; null where a side does not vary."""
    found = rows.agg(*(F.corr(F.col(n).cast("double"), F.col(target).cast("double")).alias(n) for n in names))
    return found.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.when(~F.isnan(n), F.col(n)).alias("correlation")) for n in names))).alias("x")).select("x.*")


def strongest(found: DataFrame, k: int = 10) -> DataFrame:
    """The k correlations of the greatest size with their place; of equal ones by name, and null ones last."""
    by_size = [F.desc_nulls_last(F.abs("correlation")), F.asc("feature")]
    return found.orderBy(*by_size).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*by_size)))


def patterns(rows: DataFrame, by: Column, name: str) -> DataFrame:
    """Per group: rows, mean target, median duration and median value, rounded to 3 places."""
    rows = rows.withColumn(name, by)
    found = rows.groupBy(name).agg(F.count("*").alias("n"), F.round(F.avg("target"), 3).alias("mean_target"), F.round(F.percentile(F.col("duration").cast("double"), 0.5), 3).alias("median_duration"))
    return with_median(found, rows, [name], "value", "median_value").withColumn("median_value", F.round("median_value", 3))


def value_patterns(rows: DataFrame) -> DataFrame:
    return patterns(rows, right_closed(F.col("value"), PATTERN_EDGES), "value_bin")


def coinbase_patterns(rows: DataFrame) -> DataFrame:
    return patterns(rows, F.col("tx_coinbase"), "tx_coinbase")


def heuristic_score(log_value: Column, likely_change: Column, likely_savings: Column) -> Column:
    """A hand-made probability: small and change-like outputs are spent sooner, large and savings-like ones later."""
    # The limits and points of the published rule.
    points = F.when(log_value < 3, 0.3).when(log_value > 8, -0.3).otherwise(0.0) + F.when(likely_change, 0.4).otherwise(0.0) - F.when(likely_savings, 0.5).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-points))


def threshold_sweep(scored: DataFrame, p: str, target: str, low: int = 10, high: int = 85, step: int = 5) -> DataFrame:
    """A row per threshold (percent): confusion counts, precision, recall, specificity, F1, cost 10 FN + FP and share called hot.

    Scores are first counted by the thresholds that they reach, in one pass; the thresholds then sum those few rows.
    """
    reach = F.floor(F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)) * 100 + 1e-9).cast("int")
    counts = scored.groupBy(reach.alias("reach")).agg(F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) != 1).alias("neg"))
    cuts = scored.sparkSession.range(low, high + 1, step).select(F.col("id").cast("int").alias("threshold"))
    above = F.col("reach") >= F.col("threshold")
    out = F.broadcast(cuts).crossJoin(counts).groupBy("threshold").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn), "cost": 10 * fn + fp, "hot_rate": ratio(tp + fp, tp + fp + fn + tn)}
    )


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """The threshold of the greatest F1 and that of the least cost; the lower of equals."""
    return sweep.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("best_f1"), F.min_by("threshold", F.struct("cost", "threshold")).alias("least_cost"))


def regression_metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    error = F.col(guess) - F.col(truth)
    return rows.agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))
