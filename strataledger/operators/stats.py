"""Distributions of lifespans, amounts and script sizes, overall and by segment of creation height."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataledger.functions.scalars import segment
from strataledger.schema import LAST_SEGMENT, SEGMENT


def summary(x: Column, name: str) -> list[Column]:
    """count, mean, exact median (midpoint of the middle two), min and max of the non-null values.

    For columns of few different values (ages, sizes): percentile() holds each of them. Amounts go to amount_summary.
    """
    return [
        F.count(x).alias(f"n_{name}"), F.avg(x).alias(f"mean_{name}"), F.percentile(x.cast("double"), 0.5).alias(f"median_{name}"), F.min(x).alias(f"min_{name}"), F.max(x).alias(f"max_{name}"),
    ]


def grouped_median(df: DataFrame, keys: Sequence[str], column: str, name: str = "median") -> DataFrame:
    """keys and the exact median of a non-negative whole column, for columns with very many different values.

    percentile() holds every different value of a group in one task. Here values are first counted by 4096 bins an
    octave (partial sums, at most some 200,000 rows a group), the bins of the two middle ranks are found by a running
    sum over those, and only the values in them are ranked. Nothing grows with the group but the counts.
    """
    values = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("long").alias("v"))
    binned = values.withColumn("bin", F.when(F.col("v") > 0, F.floor(F.log2(F.col("v").cast("double")) * 4096)).otherwise(-1))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    in_order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumns({"before": F.coalesce(F.sum("n").over(in_order), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*keys))})
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = ranked.where((F.col("before") <= high) & (F.col("before") + F.col("n") > low))
    same = [F.col(k).eqNullSafe(F.col(f"middle_{k}")) for k in keys] + [F.col("bin") == F.col("middle_bin")]
    found = binned.join(middle.select(*(F.col(k).alias(f"middle_{k}") for k in keys), F.col("bin").alias("middle_bin"), "before", "total"), _all(same))
    per_value = found.groupBy(*keys, "bin", "v", "before", "total").agg(F.count("*").alias("n"))
    within = Window.partitionBy(*keys, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))
    hit = lambda rank: (F.col("at") <= rank) & (F.col("at") + F.col("n") > rank)
    return (
        per_value.withColumn("at", at)
        .groupBy(*keys)
        .agg(((F.max(F.when(hit(low), F.col("v"))) + F.max(F.when(hit(high), F.col("v")))) / F.lit(2.0)).alias(name))
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def with_median(stats: DataFrame, rows: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """stats (a row a group) with the exact median of an amount of the groups' rows, by grouped_median; null where there is none."""
    found = grouped_median(rows, keys, column, name)
    if not keys:  # one row each
        return stats.crossJoin(F.broadcast(found))
    found = found.select(*(F.col(k).alias(f"of_{k}") for k in keys), name)
    return stats.join(found, _all([F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]), "left").drop(*(f"of_{k}" for k in keys))


def amount_summary(x: Column, name: str) -> list[Column]:
    """summary without the median, which with_median adds."""
    return [F.count(x).alias(f"n_{name}"), F.avg(x).alias(f"mean_{name}"), F.min(x).alias(f"min_{name}"), F.max(x).alias(f"max_{name}")]


def spent_stats(txo: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spent outputs: totals, those of lifespan 0, and lifespan statistics of the others; one pass for any keys."""
    positive = F.when(F.col("duration") > 0, F.col("duration"))
    return txo.where("event").groupBy(*keys).agg(F.count("*").alias("n_spent"), F.count_if(F.col("duration") == 0).alias("n_zero"), *summary(positive, "lifespan"))


def amount_stats(txo: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unspent outputs: statistics of amount and locking script size."""
    rows = txo.where("NOT event")
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n_unspent"), *amount_summary(F.col("value"), "value"), *summary(F.col("locking_script_size"), "script"))
    return with_median(stats, rows, keys, "value", "median_value")


def by_segment(txo: DataFrame, size: int = SEGMENT) -> DataFrame:
    return txo.withColumn("segment", segment(F.col("creation_block"), size))


def with_empty_segments(stats: DataFrame, size: int = SEGMENT, last: int = LAST_SEGMENT) -> DataFrame:
    """stats with a row for every segment up to the last; counts of the empty ones are 0."""
    segments = stats.sparkSession.range(0, last + 1, size).select(F.col("id").cast("int").alias("segment"))
    found = segments.join(stats, "segment", "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in stats.columns if c.startswith("n_")})


def histogram(df: DataFrame, x: Column, edges: Sequence[float], rule: Callable[[Column, Sequence[float]], Column]) -> DataFrame:
    """(bin, n) with a row for every bin, counted or not, and one of a null bin for values outside all bins."""
    counts = df.where(x.isNotNull()).groupBy(rule(x, edges).alias("found")).agg(F.count("*").alias("counted"))
    bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin")).unionAll(df.sparkSession.sql("SELECT CAST(NULL AS INT) AS bin"))
    return bins.join(F.broadcast(counts), F.col("bin").eqNullSafe(F.col("found")), "left").select("bin", F.coalesce("counted", F.lit(0)).alias("n"))


def equal_width_histogram(df: DataFrame, column: str, bins: int = 100, keys: Sequence[str] = (), common: Sequence[str] | None = None) -> DataFrame:
    """(keys, bin, low, n): bins of equal width from the least to the greatest value, the last one closed; empty bins have no row.

    Each group of keys has its own ends, or, with `common` (some of the keys), those of all groups that agree in these:
    sides can then be compared bin by bin.
    """
    of = list(keys if common is None else common)
    own = df.groupBy(*of).agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).select(*(F.col(k).alias(f"end_{k}") for k in of), "lo", "hi")
    rows = df.where(F.col(column).isNotNull()).select(*keys, column)
    # a row a group of keys: segments and sides, never outputs
    met = rows.join(F.broadcast(own), _all([F.col(k).eqNullSafe(F.col(f"end_{k}")) for k in of])) if of else rows.crossJoin(F.broadcast(own))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    placed = met.select(*keys, F.when(F.col("hi") > F.col("lo"), at).otherwise(0).alias("bin"), "lo", "hi")
    return placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.first(F.col("lo")).alias("lo"), F.first(F.col("hi")).alias("hi")).select(*keys, "bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("low"), "n")


def compare_spent_unspent(txo: DataFrame) -> DataFrame:
    """Mean and median amount and script size of spent (lifespan over 0) and unspent outputs, and their ratios; null where the divisor is 0."""
    side = F.when(F.col("event") & (F.col("duration") > 0), "spent").when(~F.col("event"), "unspent")
    rows = txo.select(side.alias("side"), "value", "locking_script_size").where("side IS NOT NULL")
    found = [F.avg("value").alias("mean_value"), F.avg("locking_script_size").alias("mean_script"), F.percentile(F.col("locking_script_size").cast("double"), 0.5).alias("median_script")]
    by_side = with_median(rows.groupBy("side").agg(*found), rows, ["side"], "value", "median_value")  # a row a side
    names = [f"{what}_{name}" for name in ("value", "script") for what in ("mean", "median")]
    both = by_side.agg(*(F.max(F.when(F.col("side") == of, F.col(n))).alias(f"{n}_{of}") for n in names for of in ("spent", "unspent")))
    return both.withColumns({f"{what}_{name}_ratio": F.try_divide(F.col(f"{what}_{name}_unspent"), F.col(f"{what}_{name}_spent")) for name in ("value", "script") for what in ("mean", "median")})


def compare_segments(txo: DataFrame, how: str = "full_outer") -> DataFrame:
    """Spent and unspent counts and mean amounts by segment; ratio only where both sides have outputs.

    full_outer has every segment of either side, inner those of both; one aggregation serves both sides.
    """
    found = by_segment(txo).groupBy("segment").agg(
        F.count_if("event").alias("n_spent"), F.count_if(~F.col("event")).alias("n_unspent"), F.avg(F.when(F.col("event"), F.col("value"))).alias("mean_value_spent"), F.avg(F.when(~F.col("event"), F.col("value"))).alias("mean_value_unspent")
    )
    found = found.withColumn("value_ratio", F.try_divide("mean_value_unspent", "mean_value_spent"))
    return found.where("n_spent > 0 AND n_unspent > 0") if how == "inner" else found


def segment_medians(txo: DataFrame) -> DataFrame:
    """Median amounts of spent and unspent outputs by segment, and their ratio where both sides have outputs."""
    found = grouped_median(by_segment(txo), ["segment", "event"], "value")
    side = lambda is_: F.max(F.when(F.col("event") == is_, F.col("median")))
    both = found.groupBy("segment").agg(side(True).alias("median_value_spent"), side(False).alias("median_value_unspent"))
    return both.withColumn("median_value_ratio", F.try_divide("median_value_unspent", "median_value_spent"))


def rollup_segments(txo: DataFrame) -> DataFrame:
    """Spent statistics by segment and overall (null segment) in one plan."""
    spent = by_segment(txo).where("event")
    return spent.rollup("segment").agg(F.count("*").alias("n_spent"), F.sum("value").alias("sum_value"), F.percentile(F.col("duration").cast("double"), 0.5).alias("median_duration"))


def top_ages(txo: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent lifespans of spent outputs with their percentage; the smaller age first among equals."""
    ages = txo.where("event").groupBy(F.col("duration").alias("age")).agg(F.count("*").alias("n"))
    total = ages.agg(F.sum("n").alias("total"))  # from the same shuffled counts
    return ages.orderBy(F.desc("n"), "age").limit(k).crossJoin(F.broadcast(total)).select("age", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def age_distribution(txo: DataFrame) -> DataFrame:
    return txo.where("event").agg(F.count("*").alias("n"), F.countDistinct("duration").alias("n_ages"), F.max("duration").alias("max_age"), F.avg("duration").alias("mean_age"))
