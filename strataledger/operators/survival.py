"""Kaplan-Meier survival of outputs by age in blocks, and lookups in the curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataledger.operators.asof import step_at


def kaplan_meier(rows: DataFrame, duration: str = "duration", event: str = "event") -> DataFrame:
    """(duration, at_risk, deaths, survival): the product-limit estimate, with a row of 1 at age 0.

    Rows are summed by duration first; the running sums go over one row for each different duration, of which there
    are fewer than the horizon has blocks, however many outputs there are. Survival is 0 from where all at risk died.
    """
    ages = rows.groupBy(F.col(duration).alias("duration")).agg(F.count("*").alias("n"), F.count_if(event).alias("deaths"))
    ages = ages.unionAll(rows.sparkSession.sql("SELECT 0 AS duration, 0L AS n, 0L AS deaths")).groupBy("duration").agg(F.sum("n").alias("n"), F.sum("deaths").alias("deaths"))
    later = Window.orderBy(F.desc("duration")).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)
    risk = ages.withColumn("at_risk", F.sum("n").over(later))
    over = (F.col("deaths") == F.col("at_risk")) & (F.col("deaths") > 0)
    factor = F.when(over, 0.0).otherwise(F.coalesce(F.ln(1.0 - F.try_divide("deaths", "at_risk")), F.lit(0.0)))
    curve = risk.withColumns({"log": F.sum(factor).over(earlier), "dead": F.max(over).over(earlier)})
    return curve.select("duration", "at_risk", "deaths", F.when(F.col("dead"), 0.0).otherwise(F.exp("log")).alias("survival"))


def survival_at(probes: DataFrame, curve: DataFrame, at: str = "at") -> DataFrame:
    """probes with the survival at the greatest age of the curve that is not above theirs; null before the first."""
    return step_at(probes, curve, at, "duration", "survival", "survival")


def save_curve(curve: DataFrame, path: str) -> None:
    """The curve as Parquet, in order of age: a row a different age."""
    curve.repartitionByRange(1, "duration").sortWithinPartitions("duration").write.mode("overwrite").parquet(path)


def load_curve(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("duration int, at_risk long, deaths long, survival double").parquet(path)
