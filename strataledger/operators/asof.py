"""Steps looked up by the greatest place that is not above a probe's, and sweeps over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places of a run; a task orders at most so many different probes and steps.
WIDTH = 10_000


def step_at(probes: DataFrame, steps: DataFrame, at: str, place: str, value: str, name: str) -> DataFrame:
    """probes with `name`: the value of the step at the greatest place not above `at`; null before the first and for a null `at`.

    Only different probes are ordered with the steps, by runs of WIDTH places, and joined back by equality, so neither
    many equal probes nor many in one run meet in a task. A run starts from the last step of the runs before, which
    are looked up in the same way, runs of runs.
    """
    points = probes.select(F.col(at).cast("long").alias("t")).where("t IS NOT NULL").distinct()
    found = _carried(points, steps.select(F.col(place).cast("long").alias("t"), F.col(value).alias("v")), 2)
    return probes.join(found.select(F.col("t").alias("t_"), F.col("v").alias(name)), F.col(at).cast("long") == F.col("t_"), "left").drop("t_")


def _carried(points: DataFrame, steps: DataFrame, levels: int) -> DataFrame:
    """(t, v) of each point: the value of the last step up to it."""
    kind = steps.schema["v"].dataType
    both = points.select("t", F.lit(None).cast(kind).alias("v"), F.lit(1).alias("kind")).unionAll(steps.select("t", "v", F.lit(0).alias("kind")))
    last = lambda w: F.last("v", ignorenulls=True).over(w.orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    if not levels:  # a row for each WIDTH * WIDTH places
        return both.withColumn("v", last(Window.partitionBy())).where("kind = 1").select("t", "v")
    run = F.floor(F.col("t") / WIDTH)
    ends = steps.groupBy(run.alias("run")).agg(F.max_by("v", "t").alias("v")).select(F.col("run").alias("t"), "v")
    before = _carried(points.select((run - 1).alias("t")).distinct(), ends, levels - 1).select((F.col("t") + 1).alias("start_run"), F.col("v").alias("start"))
    inside = both.withColumn("run", run).withColumn("v", last(Window.partitionBy("run"))).where("kind = 1")
    return inside.join(before, F.col("run") == F.col("start_run"), "left").select("t", F.coalesce("v", "start").alias("v"))


def covering(probes: DataFrame, ranges: DataFrame, at: str, low: str, high: str, name: str) -> DataFrame:
    """probes with `name`: how many ranges [low, high] hold `at`.

    Ranges open and close in one order of places; the number open is a running sum over places at which it changes, and
    probes look it up as a step. No probe meets a range, however many there are of both.
    """
    count = lambda place, by: ranges.select(F.col(place).cast("long").alias("t"), F.lit(by).alias("by"))
    moves = count(low, 1).unionAll(count(high, -1).withColumn("t", F.col("t") + 1)).where("t IS NOT NULL").groupBy("t").agg(F.sum("by").alias("by"))
    return step_at(probes, _running(moves), at, "t", "open", name).withColumn(name, F.coalesce(name, F.lit(0)))


def _running(moves: DataFrame) -> DataFrame:
    """(t, open): the running sum of moves (t, by), by runs of WIDTH places; the sums of runs are added up apart."""
    run: Column = F.floor(F.col("t") / WIDTH)
    up_to = Window.partitionBy("run").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    sums = moves.groupBy(run.alias("run")).agg(F.sum("by").alias("by"))
    before = F.coalesce(F.sum("by").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("run").alias("start_run"), before.alias("start"))
    inside = moves.withColumn("run", run).withColumn("open", F.sum("by").over(up_to))
    return inside.join(starts, F.col("run") == F.col("start_run")).select("t", (F.col("open") + F.col("start")).alias("open"))
